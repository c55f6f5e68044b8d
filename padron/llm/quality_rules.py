"""Quality rules by distribution divergence.

A document's character classes and common words are two histograms. Each is compared, by
Jensen-Shannon distance (base 2, so 0 to 1), with that of its language in the same table. Short
texts stray further by chance alone, so the distance allowed falls with the length, and below a
minimum length a test is not made.

One pass over the texts makes a small row of counts per document, which is written. References are
counted over all these rows but those that fail the base rules: first the median of each bin, which
rows unlike the rest hardly move while they are fewer than half of the language, then ``PASSES``
times the mean of the rows that the reference before does not reject. There are five at most, one
per language of ``COMMON`` and one for the rest; they are sent to the last pass. All but the first
read the counts alone. Where junk is the larger part of a language, it is the reference.

Defined results: a null or empty text has no words and fails the base rules. A row whose
language is null or not listed is held against the nearest reference. Each row gives one row,
repeated or not. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from padron.llm.words import WordMemory, as_text, shingle_hashes, with_key, word_hash
from padron.session import saved

# Frequent function words of each language.
COMMON = {
    "en": "the of and to in a is that for it was on are with as be at by this from he have not or",
    "fr": "de la le et les des un une du en que est pour qui dans par sur pas au plus ne se ce il",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an aus",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más o pero",
}
#: Character classes: lower, upper, digit, space, line feed, sentence marks, symbols, others of
#: ASCII, letters and signs beyond ASCII.
CLASSES = 9
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """Distances allowed: ``floor + slope / sqrt(length)``; lengths below which no test is made."""

    char_floor: float = 0.12
    char_slope: float = 2.2
    char_least: int = 100
    word_floor: float = 0.12
    word_slope: float = 2.2
    word_least: int = 100


def _byte_classes() -> np.ndarray:
    table = np.full(256, 7, np.uint8)
    for name, letters in enumerate(
        ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".,;:!?'\"()-", SYMBOLS + "@^~{}[]\\/=+_`")
    ):
        table[list(letters.encode())] = name
    table[0x80:0xC0] = CLASSES  # continues a code point
    table[0xC0:] = 8
    return table


_TABLE = _byte_classes()
_WORDS = sorted({w for words in COMMON.values() for w in words.split()})
_PLACE = {w.encode(): i + 1 for i, w in enumerate(_WORDS)}
BINS = CLASSES + len(_WORDS) + 1
#: Steps of a share's square root, for medians; passes of means after them.
LEVELS, PASSES = 500, 2
_SHIFT = 7  # the low bits of a remembered word hold its place among common words
_EDGES = ".,;:!?'\"()-".encode()


def _remembered(word: bytes) -> int:
    place = _PLACE.get(word.strip(_EDGES).lower(), 0)
    return word_hash(word) >> _SHIFT << _SHIFT | place


def counts(text: str | None, memory: WordMemory) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, common words."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    found = data.split()
    n = len(found)
    kinds = np.bincount(_TABLE[np.frombuffer(data, np.uint8)], minlength=CLASSES + 1)[:CLASSES]
    white = sum(map(data.count, b" \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    dup_lines = 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
        elif line.strip(" \t\x0b\x0c\r"):
            seen.add(line)
    h = np.fromiter(map(memory.__getitem__, found), np.uint64, n)
    places = np.bincount((h & np.uint64((1 << _SHIFT) - 1)).astype(np.int64), minlength=len(_WORDS) + 1)
    return (
        n,
        int(kinds.sum()) - white,
        symbols,
        dup_lines,
        repeat_words(h),
        kinds.tolist(),
        places.tolist(),
    )


def repeat_words(h: np.ndarray) -> int:
    """Words that are in a 3-word window found twice or more."""
    if len(h) < 4:
        return 0
    _, which, times = np.unique(shingle_hashes(h, 3), return_inverse=True, return_counts=True)
    often = np.flatnonzero(times[which] > 1)
    inside = np.zeros(len(h), bool)
    for step in range(3):
        inside[often + step] = True
    return int(inside.sum())


_COUNTS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " classes array<long>, places array<long>"
)


def measured(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(key, lang, counts) of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = WordMemory(_remembered)
        names = [c.split()[0] for c in _COUNTS.split(", ")]
        for batch in batches:
            out = pd.DataFrame([counts(t, memory) for t in batch["text"]], columns=names)
            out.insert(0, "lang", batch["lang"].array)
            out.insert(0, "key", batch["key"].array)
            yield out

    rows = df.select(as_text(key), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    return rows.mapInPandas(run, f"key string, lang string, {_COUNTS}")


Reference = tuple[np.ndarray, np.ndarray]


def _histograms(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    classes = np.array(batch["classes"].tolist(), float).reshape(len(batch), CLASSES)
    places = np.array(batch["places"].tolist(), float).reshape(len(batch), len(_WORDS) + 1)
    return classes, places


def _shares(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(rows.sum(1, keepdims=True), 1e-300)


def base_failed(batch: pd.DataFrame) -> np.ndarray:
    n_words = batch["n_words"].to_numpy()
    return (n_words < 50) | (100 * batch["n_repeat_words"].to_numpy() > 50 * n_words)


def medians(rows: DataFrame) -> dict[str, Reference]:
    """Median of each bin per listed language, and of the rest."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        times: dict[str, np.ndarray] = {}
        for batch in batches:
            batch = batch[~base_failed(batch)]
            level = np.rint(np.sqrt(np.hstack([*map(_shares, _histograms(batch))])) * LEVELS).astype(np.int64)
            for name, at in _by_language(batch):
                own = times.setdefault(name, np.zeros((BINS, LEVELS + 1), np.int64))
                flat = (level[at] + np.arange(BINS) * (LEVELS + 1)).ravel()
                own += np.bincount(flat, minlength=own.size).reshape(own.shape)
        for name, own in times.items():
            bins, levels = np.nonzero(own)
            yield pd.DataFrame({"language": name, "bin": bins, "level": levels, "n": own[bins, levels]})

    # A row per language, bin and level at most.
    found = (
        rows.mapInPandas(part, "language string, bin long, level long, n long")
        .groupBy("language", "bin", "level")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    out = {}
    for name, own in found.groupby("language"):
        times = np.zeros((BINS, LEVELS + 1))
        times[own["bin"], own["level"]] = own["n"]
        below = times.cumsum(1)
        middle = (below >= below[:, -1:] / 2).argmax(1) / LEVELS
        out[name] = _reference(middle * middle)
    return out


def means(rows: DataFrame, models: dict[str, Reference], limits: Limits) -> dict[str, Reference]:
    """Mean histograms of the rows that their language's reference does not reject."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            batch = batch[~base_failed(batch)]
            classes, places = _histograms(batch)
            share = np.hstack([_shares(classes), _shares(places)])
            for name, at in _by_language(batch):
                if name in models:
                    chars, words = models[name]
                    char_js, word_js = distance(classes[at], chars), distance(places[at], words)
                    near = ~far(batch[at], classes[at].sum(1), char_js, word_js, limits)
                    sums[name] = sums.get(name, 0) + share[at][near].sum(0)
        for name, own in sums.items():
            yield pd.DataFrame({"language": name, "bin": np.arange(BINS), "total": own})

    found = (
        rows.mapInPandas(part, "language string, bin long, total double")
        .groupBy("language", "bin")
        .agg(F.sum("total").alias("total"))
        .toPandas()
    )
    out = dict(models)
    for name, own in found.groupby("language"):
        if own["total"].sum() > 0:
            out[name] = _reference(own.sort_values("bin")["total"].to_numpy())
    return out


def _by_language(batch: pd.DataFrame) -> Iterator[tuple[str, np.ndarray]]:
    language = batch["lang"].where(batch["lang"].isin(list(COMMON)), "")
    for name in language.unique():
        yield name, (language == name).to_numpy()


def _reference(bins: np.ndarray) -> Reference:
    chars, words = bins[:CLASSES], bins[CLASSES:]
    return chars / max(chars.sum(), 1e-300), words / max(words.sum(), 1e-300)


def references(rows: DataFrame, limits: Limits) -> dict[str, Reference]:
    """Histograms of classes and common words that most rows of a language are near to."""
    models = medians(rows)
    for _ in range(PASSES):
        models = means(rows, models, limits)
    return models


def distance(rows: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row's histogram from the reference."""
    p = _shares(rows)
    m = (p + reference) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0.0).sum(1)
        right = np.where(reference > 0, reference * np.log2(reference / m), 0.0).sum(1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def far(
    batch: pd.DataFrame, n_chars: np.ndarray, char_js: np.ndarray, word_js: np.ndarray, limits: Limits
) -> np.ndarray:
    """Rows over one of the distances allowed at their length."""
    n_words = batch["n_words"].to_numpy()
    char_limit = limits.char_floor + limits.char_slope / np.sqrt(np.maximum(n_chars, 1))
    word_limit = limits.word_floor + limits.word_slope / np.sqrt(np.maximum(n_words, 1))
    return ((n_chars >= limits.char_least) & (char_js > char_limit)) | (
        (n_words >= limits.word_least) & (word_js > word_limit)
    )


def judged(batch: pd.DataFrame, models: dict, limits: Limits) -> pd.DataFrame:
    """Distances from the own or nearest reference, and the verdict."""
    classes, places = _histograms(batch)
    char_js, word_js = np.ones(len(batch)), np.ones(len(batch))
    nearest = ~batch["lang"].isin([x for x in models if x]).to_numpy()
    for name, (char_reference, word_reference) in models.items():
        at = nearest | (batch["lang"] == name).to_numpy()
        if at.any():
            char_js[at] = np.minimum(char_js[at], distance(classes[at], char_reference))
            word_js[at] = np.minimum(word_js[at], distance(places[at], word_reference))
    failed = base_failed(batch)
    kept = ~failed & ~far(batch, classes.sum(1), char_js, word_js, limits)
    return batch.drop(columns=["lang", "classes", "places"]).assign(
        base_failed=failed, kept=kept, char_distance=char_js, word_distance=word_js
    )


def report(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    limits: Limits = Limits(),
) -> DataFrame:
    """Per row: id, counts, base_failed, kept, and the two distances."""
    rows = saved(measured(df, key, text, lang), "quality-counts")
    models = references(rows, limits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield judged(batch, models, limits)

    shape = (
        f"key string, {_COUNTS.split(', classes')[0]}, base_failed boolean, kept boolean,"
        " char_distance double, word_distance double"
    )
    return with_key(rows.mapInPandas(run, shape), key, df.schema[key].dataType)
