"""Chat records: build, render, cut and pad."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from padron.functions.text import strip, words
from padron.lookups import CHAT_MAX_TOKENS, SYSTEM_PROMPT, TOXIC_MAX_TOKENS


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_record(question: Column, answer: Column, system: str = SYSTEM_PROMPT) -> Column:
    """system, user and assistant turns as one array."""
    return F.array(
        message("system", F.lit(system)),
        message("user", strip(question)),
        message("assistant", strip(answer)),
    )


def chat_template(messages: Column) -> Column:
    """The turns as one training text with begin and end marks."""
    turn = lambda m: F.concat(
        F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n")
    )
    return F.array_join(F.transform(messages, turn), "")


def within_budget(text: Column, limit: int = CHAT_MAX_TOKENS) -> Column:
    return F.size(words(text)) <= limit


def truncate_words(text: Column, limit: int = CHAT_MAX_TOKENS) -> Column:
    return F.slice(words(text), 1, limit)


def pad_truncate(text: Column, width: int = TOXIC_MAX_TOKENS, pad: str = "<pad>") -> Column:
    """Exactly ``width`` tokens and the mask that marks the real ones."""
    tokens = truncate_words(text, width)
    used = F.size(tokens)
    return F.struct(
        F.concat(tokens, F.array_repeat(F.lit(pad), F.lit(width) - used)).alias("tokens"),
        F.concat(
            F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), F.lit(width) - used)
        ).alias("attention_mask"),
    )
