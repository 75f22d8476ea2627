"""Where the public tokenizer files lie. Their path is a parameter of every operator that needs one."""

from __future__ import annotations


def word_bpe_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))
