"""Where the public tokenizer files are; the files stay outside the repository."""

from __future__ import annotations


def tokenizer_path(name: str) -> str:
    """Place of a tokenizer file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
