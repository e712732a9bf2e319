"""Operators over generic relations: corpus(path, text), occurrences, registries, edges, findings, edits."""
