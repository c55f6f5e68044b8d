"""Transcripts, weak labels, encoding, licences, language model."""

import gc
import hashlib
import math
import random
import textwrap
import weakref
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import ALL_IDS, CLASHING, docs, empty, ids, odd, prose, rows
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from padron.llm import bpe, chat_format, licenses, lm, quality_classifier
from padron.llm.queries import WORD_BPE

SF = "/root/testdata/sf0.001"
CONVERSATION = "conv_id long, turn long, role string, text string"

# Transcripts


def conversations(spark, n=40, turns=7):
    rows_ = []
    for c in range(n):
        rng = random.Random(c)
        for t in range(turns):
            role = "system" if t == 0 and c % 4 == 0 else "user" if (t + (c % 4 == 0)) % 2 == 0 else "assistant"
            size = {"system": 8, "user": rng.randrange(5, 15), "assistant": rng.randrange(30, 90)}[role]
            text = prose(f"{c}/{t}", size) + ("?" if role == "user" else ".\n" + prose(f"{c}/{t}/2", 12) + ".")
            rows_.append((c, t, role, text))
    return spark.createDataFrame(rows_, CONVERSATION)


def turns_of(df):
    return {(r.conv_id, r.turn): (r.role, r.text) for r in df.collect()}


def test_roles_are_recovered(spark):
    """Also, by themselves, in conversations that were not learned from."""
    for df in (conversations(spark), spark.read.parquet(f"{SF}/conversations.parquet")):
        half = df.where(~chat_format.learned_from(F.col("conv_id")))
        found = turns_of(chat_format.report(df))
        for wanted in (turns_of(df), turns_of(half)):
            assert sum(found.get(k) == v for k, v in wanted.items()) >= 0.9 * len(wanted) > 20


def test_chunks_do_not_change_turns(spark, monkeypatch, partitions):
    """Learning included, whatever the chunks and partitions; also where blank lines are missing."""
    rows_ = conversations(spark, 8, 24).collect()
    df = spark.createDataFrame([(c, t, r, x.replace("\n", "\n\n") if t % 3 else x) for c, t, r, x in rows_], CONVERSATION)
    whole = turns_of(chat_format.report(df))
    for chunk, parts in ((3, 8), (7, 2), (7, 40)):
        monkeypatch.setattr(chat_format, "CHUNK", chunk)
        partitions(parts)
        assert turns_of(chat_format.report(df)) == whole
    assert len(whole) > 150


def test_markers_inside_a_turn_stay(spark):
    listed = "Which one?\nA: red\nB: blue\nModel: T"
    rows_ = [r if r.turn != 3 else (r.conv_id, 3, r.role, listed) for r in conversations(spark).collect()]
    found = turns_of(chat_format.report(spark.createDataFrame(rows_, CONVERSATION)))
    texts = "\n".join(text for _, text in found.values())
    assert texts.count("Which one?") == 40
    kept = sum(text.endswith(listed) for _, text in found.values())
    assert kept >= 20  # the others were read as turns of their own, which such lines can be
    states = [(0, 0, 0, "A: red", 2, 1), (0, 0, 1, "A: blue\n", 3, 1)]
    lines = spark.createDataFrame(states, "name string, chunk long, seq long, line string, found int, nth long")
    monkey = pytest.MonkeyPatch()
    monkey.setattr(chat_format, "labelled", lambda *_: lines)
    try:
        row = chat_format.turns(None, None, T.LongType()).first()
    finally:
        monkey.undo()
    assert (row.role, row.text) == ("user", "red\nA: blue")


def _logs(m):
    return chat_format.Model(
        np.log(m.start / m.start.sum()), np.log(m.moves / m.moves.sum(1, keepdims=True)),
        np.log(m.emits / m.emits.sum(1, keepdims=True)),
    )


@pytest.mark.parametrize("seed", range(5))
def test_reduced_chunks_score_like_a_whole(seed):
    rng = np.random.default_rng(seed)
    model = _logs(chat_format.Model(rng.random(6), rng.random((6, 6)), rng.random((6, chat_format.SYMBOLS))))
    symbols = rng.integers(0, chat_format.SYMBOLS, 30).tolist()
    states = chat_format.decoded(symbols, model, None, None)
    score = model.start[states[0]] + sum(model.emits[s, o] for s, o in zip(states, symbols, strict=True))
    score += sum(model.moves[a, b] for a, b in zip(states, states[1:], strict=False))
    first = chat_format.reduced(symbols[:11], model, entry=False)[0]
    whole = (first[:, None] + chat_format.reduced(symbols[11:], model, entry=True)).max()
    assert whole == pytest.approx(score)


def test_transcripts_odd_and_empty(spark):
    rows_ = [(None, 0, "user", "hello there?"), (None, 1, "assistant", None), (1, None, "user", ""), (1, 0, "alien", "x"),
             (2, 0, "user", "same"), (2, 0, "user", "same"), (3, 0, None, "y" * 100_000), (4, 0, "user", "\n\n"), (1 << 60, 1, "user", "z")]
    df = spark.createDataFrame(rows_, CONVERSATION).withColumns({c: F.lit("x") for c in CLASHING if c not in ("turn", "text")})
    got = rows(chat_format.report(df))
    assert list(got.columns) == ["conv_id", "turn", "role", "text", "rendered"]
    assert {None if c is None else int(c) for c in got.conv_id.astype(object).where(got.conv_id.notna(), None)} == {None, 1, 2, 3, 4, 1 << 60}
    assert set(got.role) <= set(chat_format.ROLES)
    assert "y" * 100_000 in set(got.text)
    assert chat_format.report(spark.createDataFrame([], CONVERSATION)).collect() == []


# Weak labels


def test_expectation_maximisation_recovers_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.8, 0.75, 0.7, 0.85, 0.9, 0.65, 0.8])
    correct = rng.random((20_000, 9)) < right
    votes = np.where(correct, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.2] = quality_classifier.SILENT
    distinct, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality_classifier.estimated(distinct, counts.astype(float))
    assert abs(model.good - 0.8) < 0.03
    assert np.abs(model.right - right).max() < 0.06
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.97


def test_classifier_agrees_with_labels_it_never_saw(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = rows(quality_classifier.report(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id"))
    assert found[found.quality == 1].kept.mean() > 0.98
    assert found[found.quality == 0].kept.mean() < 0.1


def test_classifier_odd_and_empty(spark):
    df = odd(spark)
    got = rows(quality_classifier.report(df))
    assert len(got) == len(ALL_IDS) and got.score.between(0, 1).all()
    assert quality_classifier.kept(df).columns == df.columns
    assert quality_classifier.kept(empty(spark)).collect() == [] and quality_classifier.report(empty(spark)).collect() == []


def plain_classifier(texts, turns, parts):
    """Every document in its turn, in one process."""
    of = [quality_classifier.seen(t, quality_classifier.WordMemory(quality_classifier._code)) for t in texts]
    votes = np.array([quality_classifier.votes(d) for d in of])
    distinct, counts = np.unique(votes, axis=0, return_counts=True)
    labels = quality_classifier.estimated(distinct, counts.astype(float))
    p, size = labels.posterior(votes), 1 << quality_classifier.BITS
    importance = (p / p.sum() + (1 - p) / (1 - p).sum()) / 2
    made = [quality_classifier.features(d) for d in of]
    weights, slow = np.zeros(size + 1), np.full(size + 1, 1e-6)

    def scores(chosen):
        z = np.array([weights[-1] + weights[made[i][0]] @ made[i][1] for i in chosen])
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    for at in range(quality_classifier.ROUNDS):
        chosen = np.flatnonzero(turns % parts == at % parts)
        error = (p[chosen] - scores(chosen)) * importance[chosen] * parts
        grad = -1e-5 * weights
        grad[-1] = error.sum()
        for i, e in zip(chosen, error, strict=True):
            np.add.at(grad, made[i][0], e * made[i][1])
        slow += grad * grad
        weights += 0.3 * grad / np.sqrt(slow)
    return scores(range(len(texts)))


@pytest.mark.parametrize(("most", "parts"), [(1, 1), (3, 3)])
def test_scorer_is_trained_on_all_documents(spark, monkeypatch, most, parts):
    """Also beyond 4,000 documents; with and without turns."""
    monkeypatch.setattr(quality_classifier, "PARTS", most)
    monkeypatch.setattr(quality_classifier, "PART_DOCS", 1500)
    monkeypatch.setattr(quality_classifier, "ROUNDS", 12)
    texts = [prose(f"scored{i}", 21 + i % 9) if i % 5 else f"## {i} $$ || ** " * (3 + i % 7) for i in range(4700)]
    df = docs(spark, [None, "", *texts], [None, None, *range(len(texts))])
    turn = df.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(quality_classifier.TURNS)).alias("at"))
    found = sorted(turn.collect(), key=lambda r: (r.doc_id is not None, r.doc_id, r.text is not None))
    wanted = plain_classifier([r.text for r in found], np.array([r.at for r in found]), parts)
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.score) for r in quality_classifier.report(df).collect())
    assert len(got) == len(texts) + 2
    assert np.allclose([x for _, x in got], wanted, atol=1e-4)


# Encoding


@pytest.fixture(scope="module")
def vocabulary():
    with open(WORD_BPE, "rb") as file:
        return bpe.Vocabulary(file.read())


ODD_STRINGS = [
    "", " ", "\x1c a\x1db \x85c\xa0d​e᠎f g", "Σίσυφος ΣΑΣ", "İstanbul ſ K", "<|endoftext|>x<|startoftext|> <|end",
    "a" * 3000, "é ́x क्षि  日本語テスト 😀😀👩‍👩‍👧", "I'LL don't 's'S 'tis x'sy 123 ½ ٣٤ ²", "   \x00 \x7f", "ΑΣ<|endoftext|>́a", "ǅ ŉ ß ẞ ﬁ",
]


def test_ids_equal_the_library(vocabulary):
    library, rng = Tokenizer.from_file(WORD_BPE), random.Random(7)
    letters = ["a", "b", "the", " ", "'", "s", "l", "É", "é", "́", "Σ", "1", "\n", "<|endoftext|>", "😀", "ñ", "\x85", "İ", "ß", "-", "\x1f", "한"]
    texts = ODD_STRINGS + ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(1500)]
    for text in texts:
        wanted = library.encode(text, add_special_tokens=False).ids
        assert vocabulary.encode(text) == wanted
        assert vocabulary.decode(wanted) == library.decode(wanted, skip_special_tokens=False)


def test_digests_and_columns(spark, vocabulary):
    library = Tokenizer.from_file(WORD_BPE)
    df = docs(spark, ODD_STRINGS + [prose(1, 500), None])
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    for r in bpe.token_digest(df, WORD_BPE).collect():
        found = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = library.decode(found, skip_special_tokens=False)
        digest = hashlib.sha256(" ".join(map(str, found)).encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256) == (len(found), digest)
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    both = df.withColumn("ids", bpe.encoded(df, WORD_BPE))
    both = both.withColumn("back", bpe.decoded(both, WORD_BPE, "ids"))
    for r in both.collect():
        assert r.ids == vocabulary.encode(r.text) and r.back == vocabulary.decode(r.ids)


def test_memory_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(bpe, "PIECES", 50)
    with open(WORD_BPE, "rb") as file:
        small = bpe.Vocabulary(file.read(), 50)
    text = prose(4, 2000)
    assert small.encode(text) == Tokenizer.from_file(WORD_BPE).encode(text, add_special_tokens=False).ids
    assert len(small._known) <= 50
    assert small.summary(text) == bpe.Vocabulary(open(WORD_BPE, "rb").read()).summary(text)
    assert len(small._words) <= 50


def test_a_worker_keeps_the_memory_of_one_stage():
    codes = weakref.ref(quality_classifier._memory())
    with open(WORD_BPE, "rb") as file:
        vocabulary = weakref.ref(bpe._loaded(file.read()))
    gc.collect()
    assert codes() is None
    quality_classifier._memory()
    gc.collect()
    assert vocabulary() is None


def test_encoding_odd_and_empty(spark):
    got = rows(bpe.token_digest(odd(spark), WORD_BPE))
    assert ids(bpe.token_digest(odd(spark), WORD_BPE)) == ALL_IDS
    assert got[got.doc_id.isin([1, 2, 3])].n_tokens.tolist() == [0, 0, 0]
    assert bpe.token_digest(empty(spark), WORD_BPE).collect() == []


# Licences


@pytest.fixture(scope="module")
def scanner():
    return licenses.fitted([prose(f"l{i}", 30) for i in range(400)])


def test_licences_in_noise_are_found(scanner):
    rng, hit, n = random.Random(3), 0, 0
    for family, texts in licenses.TEMPLATES.items():
        for text in texts:
            for _ in range(5):
                line = f"{prose(rng.random(), rng.randrange(6))} {text} {prose(rng.random(), rng.randrange(6))}"
                found = licenses.scan(f"{prose(rng.random(), 50)}\n{line}\n{prose(rng.random(), 20)}", scanner)
                hit += [(at, f) for at, f, _, _ in found] == [(1, family)]
                n += 1
    assert hit >= 0.95 * n


def test_unlisted_licences_are_unknown_and_prose_is_nothing(scanner):
    found = licenses.scan("This tool is licensed under the Bar Community Public License.", scanner)
    assert [f for _, f, _, _ in found] == [licenses.UNKNOWN]
    assert sum(bool(licenses.scan(prose(f"x{i}", 200), scanner)) for i in range(200)) == 0
    long = f"{prose('a', 300)} Released under the MIT License. {prose('b', 300)}"
    assert "MIT" in {f for _, f, _, _ in licenses.scan(long, scanner)}


def test_licences_of_the_table(spark):
    lines = {
        "GPL": "gnu general public license, version 3.", "CC-BY-NC": "licensed under cc by-nc 4.0.",
        "MIT": "released under the mit license.", "Apache": "licensed under the apache license, version 2.0.",
    }
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.doc_id: r for r in licenses.report(df).collect()}
    wanted = {r.doc_id: ",".join(sorted(f for f, x in lines.items() if x in r.text.lower())) for r in df.collect()}
    assert {i: r.families for i, r in found.items()} == wanted and any(wanted.values())


def test_notices_of_a_third_of_the_documents_are_found(spark):
    """Notices that the corpus itself repeats."""
    notices = {"MIT": licenses.TEMPLATES["MIT"][1], "BSD": licenses.TEMPLATES["BSD"][0]}
    texts = [prose(f"t{i}", 40) for i in range(300)]
    for i in range(0, 300, 3):
        texts[i] += "".join(f"\n\n{notices[f]}" for f in notices)
    found = {r.doc_id: r.families for r in licenses.report(docs(spark, texts)).collect()}
    assert found == {i + 1: "" if i % 3 else "BSD,MIT" for i in range(300)}


@pytest.mark.parametrize("width", [40, 72, 79])
@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_wrapped_notices_are_found_at_their_first_line(scanner, width, mark):
    for family, texts in licenses.TEMPLATES.items():
        for text in texts:
            wrapped = textwrap.wrap(text, width)
            comment = "\n".join(mark + line for line in wrapped)
            for before, place in (("", 0), (f"{prose(text, 40)}\n{mark}\n", 2), (f"{prose(text, 25)}\n", 1)):
                found = licenses.scan(f"{before}{comment}\n{mark}\n{prose(family, 30)}", scanner)
                assert [(at, f) for at, f, _, _ in found] == [(place, family)]


def test_notices_next_to_each_other_are_all_found(scanner):
    notices = [(f, textwrap.wrap(max(licenses.TEMPLATES[f], key=len), 60)) for f in ("Apache", "MIT", "LGPL")]
    text = "\n".join(line for _, lines in notices for line in lines)
    at = [0, len(notices[0][1]), len(notices[0][1]) + len(notices[1][1])]
    found = licenses.scan(text, scanner)
    assert [(a, f) for a, f, _, _ in found] == list(zip(at, ("Apache", "MIT", "LGPL"), strict=True))


def test_licences_odd_and_empty(spark):
    got = rows(licenses.report(odd(spark)))
    assert len(got) == len(ALL_IDS) and (got.n_found == 0).all()
    assert licenses.report(empty(spark)).collect() == []


# Language model


def plain_scores(texts, learn_from):
    """(tokens, known, N, base, score) per text, and the probability function."""
    end, start = "\n", "<s>"
    docs_ = [[w.decode() for w in (t or "").encode().lower().split()] + [end] for t in texts]
    ones, twos = Counter(), Counter()
    for d, learn in zip(docs_, learn_from, strict=True):
        if learn:
            ones.update(d)
            twos.update(zip([start, *d], d, strict=False))
    n, v = sum(ones.values()), len(ones)
    by = Counter(twos.values())
    d2 = [0, *lm.discounts(*(by[i] for i in (1, 2, 3, 4)))]
    before = Counter(b for _, b in twos)
    by = Counter(before.values())
    d1 = [0, *lm.discounts(*(by[i] for i in (1, 2, 3, 4)))]
    kinds = max(len(twos), 1)
    rest = sum(d1[min(c, 3)] for c in before.values()) / kinds if twos else 1.0
    total, left = Counter(), Counter()
    for (a, _), c in twos.items():
        total[a] += c
        left[a] += d2[min(c, 3)]

    def p(a, b):
        alone = rest / (v + 1) + max(before[b] - d1[min(before[b], 3)], 0) / kinds
        if not total[a]:
            return alone
        c = twos.get((a, b), 0)
        return max(c - d2[min(c, 3)], 0) / total[a] + left[a] / total[a] * alone

    out = [
        (len(d), sum(w in ones for w in d), n, sum(math.log10((ones[w] + 1) / (n + v + 1)) for w in d),
         sum(math.log10(p(a, b)) for a, b in zip([start, *d], d, strict=False)))
        for d in docs_
    ]
    return out, p, ones


def test_scores_equal_a_plain_model(spark, monkeypatch):
    texts = [prose(i, 80, 300) for i in range(60)] + [None, "", "THE the The", "unseen words only here"]
    learn = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(1, len(texts) + 1)]
    wanted, p, known = plain_scores(texts, learn)
    for block in (1_500_000, 500):
        monkeypatch.setattr(lm, "BLOCK", block)
        for r in lm.report(docs(spark, texts)).collect():
            n, seen, total, base, score = wanted[r.doc_id - 1]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not learn[r.doc_id - 1], n, seen, total)
            assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)
            assert r.perplexity == pytest.approx(10 ** (-score / n))
    for a in ("the", "<s>", "nowhere"):
        assert sum(p(a, b) for b in known) + p(a, "never seen") == pytest.approx(1)


def test_model_beats_the_base_on_held_out_text(spark):
    got = rows(lm.report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() and (got.score < 0).all()


def test_language_model_odd_and_empty(spark):
    got = rows(lm.report(odd(spark)))
    assert len(got) == len(ALL_IDS) and np.isfinite(got.score).all()
    assert got[got.doc_id.isin([1, 2, 3])].n_tokens.tolist() == [1, 1, 1]
    assert lm.report(empty(spark)).collect() == []
    nothing = docs(spark, ["a b"], [next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)])
    only = lm.report(nothing).first()
    assert (only.held_out, only.n_known, only.train_tokens, only.score, only.base_score) == (True, 0, 0, 0.0, 0.0)
