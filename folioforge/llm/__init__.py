"""Operators on texts, scores and labels for language-model data. Nothing outside this subpackage imports it."""
