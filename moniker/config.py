"""Settings, passed explicitly to whatever uses them."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    uri: str = "moniker.store"
    fuzzy_threshold: float = 0.97
    limit: int = 10
    min_length: int = 4
    min_token_length: int = 4
    percolate_block_limit: int = 10_000
    percolate_min_should_match: int = 2
    min_caption_length: int = 6
    debug: bool = False

    @classmethod
    def from_env(cls, prefix: str = "MONIKER_") -> Settings:
        """Each field from PREFIX + its upper-case name, debug from DEBUG, too."""
        found: dict[str, object] = {}
        for f in fields(cls):
            text = os.environ.get(prefix + f.name.upper(), os.environ.get("DEBUG") if f.name == "debug" else None)
            if text is not None:
                found[f.name] = text.lower() in ("1", "true", "yes") if f.type == "bool" else {"int": int, "float": float, "str": str}[str(f.type)](text)
        return cls(**found)  # type: ignore[arg-type]


MIN_TOKEN_COUNT = 2
MIN_TOKEN_CHARS = 2
SCHEMATA = ("LegalEntity", "Organization", "PublicBody", "Company", "Person", "Address")
DEFAULT_SCHEMA = "LegalEntity"
PARENTS = {"Person": "LegalEntity", "Organization": "LegalEntity", "Company": "Organization", "PublicBody": "Organization"}
COUNTRY_PROPERTIES = ("country", "nationality", "jurisdiction", "citizenship", "mainCountry", "registrationCountry")
NAME_PROPERTIES = ("name", "previousName", "alias", "weakAlias", "abbreviation")
