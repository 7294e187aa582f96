"""Operators for large text corpora: mixing, sharding, search, joins, language, secrets, tokens, copies, chats."""
