"""Schemas of the tables."""

from __future__ import annotations

ENTITY = "id string, schema string, properties map<string, array<string>>"
FACTS = "key string, schema string, kind string, value string"
CLUSTERS = "key string, names array<string>, aliases array<string>, countries array<string>, schemata array<string>"
PATTERNS = "pattern string, n_tokens int, first_bigram string, schema string"
