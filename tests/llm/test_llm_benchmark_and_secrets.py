"""Benchmark decontamination and secret scan."""

import hashlib
import random
import re

import numpy as np
import pytest
from helpers import ALL_IDS, docs, empty, ids, odd, prose, rows

import corpus_pipeline
from padron.llm import decontamination, secrets


def plain_subsequence(x, y):
    best = [0] * (len(y) + 1)
    for a in x:
        diagonal = 0
        for j, b in enumerate(y, 1):
            diagonal, best[j] = best[j], diagonal + 1 if a == b else max(best[j], best[j - 1])
    return best[-1]


@pytest.mark.parametrize("seed", range(20))
def test_subsequence(seed):
    rng = random.Random(seed)
    x = [rng.randrange(6) for _ in range(rng.randrange(90))]
    y = [rng.randrange(6) for _ in range(rng.randrange(150))]
    assert decontamination.subsequence(x, y) == plain_subsequence(x, y)


@pytest.fixture(scope="module")
def planted(spark):
    """120 documents: 20 hold an item, 15 a paraphrase (a fifth of the words changed)."""
    rng = random.Random(5)
    items = [(i, prose(f"item{i}", rng.choice([15, 30, 60, 150]))) for i in range(40)] + [(90, ""), (91, None)]
    texts, wanted = [], {}
    for i in range(120):
        body = prose(f"doc{i}", rng.randrange(40, 400)).split()
        if i < 35:
            item, text = items[i]
            words = text.split()
            if i >= 20:
                for at in rng.sample(range(len(words)), len(words) // 5):
                    words[at] = f"other{rng.randrange(9999)}"
            at = rng.randrange(len(body))
            body[at:at] = words
            wanted[i + 1] = item
        texts.append(" ".join(body))
    return docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), wanted, dict(items), texts


def test_planted_passages_are_found_and_nothing_else(planted):
    df, items, wanted, _, _ = planted
    found = rows(decontamination.matches(df, items))
    pairs = set(zip(found.doc_id, found.item_id, strict=True))
    assert len(pairs & set(wanted.items())) >= 0.95 * len(wanted)
    assert {d for d, _ in pairs} <= set(wanted)
    kept = set(ids(decontamination.decontaminated(df, items)))
    assert kept >= set(range(36, 121)) and kept == set(range(1, 121)) - {d for d, _ in pairs}


def test_recall_against_brute_force(planted):
    """Every passage against every window of every document, without the latent space."""
    df, items, _, texts_of_items, texts = planted
    limits = decontamination.Limits()
    truth = set()
    for d, text in enumerate(texts, 1):
        found = decontamination.words(text)
        for item, body in texts_of_items.items():
            words = decontamination.words(body)
            for part in decontamination.passages(words):
                number = {w: i for i, w in enumerate(dict.fromkeys(part))}
                have = [number.get(w, -1) for w in found]
                if len(number.keys() & set(found)) < limits.copy * len(number):
                    continue
                own = [number[w] for w in part]
                for a in range(0, len(have), 16):
                    if decontamination.subsequence(own, have[a : a + 2 * len(part)]) >= limits.copy * len(part):
                        truth.add((d, item))
                        break
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(df, items).collect()}
    assert truth and len(truth & got) >= 0.9 * len(truth)


def test_recall_on_a_full_block(spark):
    """2,048 items of 5 to 60 words; documents with one each, 0 to 35 % of its words changed."""
    rng = random.Random(8)
    items = [(i, prose(f"full{i}", 5 + i % 56, 40_000)) for i in range(decontamination.BLOCK)]
    texts, wanted = [], set()
    for i in range(0, len(items), 4):
        body, own = prose(f"held{i}", 200, 40_000).split(), items[i][1].split()
        words = list(own)
        for at in rng.sample(range(len(words)), int(len(words) * rng.choice([0, 0.1, 0.25, 0.35]))):
            words[at] = f"other{rng.randrange(9999)}"
        share = plain_subsequence(own, words) / len(own)
        answer = own[-decontamination.ANSWER_WORDS :]
        if share >= 0.8 or plain_subsequence(answer, words) >= 0.5 * len(answer):
            wanted.add((len(texts) + 1, i))
        at = rng.randrange(len(body))
        body[at:at] = words
        texts.append(" ".join(body))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.matches(docs(spark, texts), benchmark).collect()}
    short = {w for w in wanted if len(items[w[1]][1].split()) <= 20}
    assert len(wanted) > 400 and len(short) > 100
    assert len(short & found) >= 0.99 * len(short) and len(wanted & found) >= 0.99 * len(wanted)


def test_space_holds_the_passages(spark):
    """With full rank the latent product is the plain one."""
    rng = np.random.default_rng(0)
    rows_ = [(np.flatnonzero(m).tolist(), rng.random(int(m.sum())).tolist(), 1.0) for m in rng.random((12, 30)) < 0.4]
    df = spark.createDataFrame(rows_, "ids array<int>, weights array<double>, scale double")
    space = decontamination.latent(df, 30, 12)
    full = np.zeros((12, 30))
    for at, (i, w, _) in enumerate(rows_):
        full[at, i] = w
    assert np.allclose((full @ space) @ (full @ space).T, full @ full.T, atol=1e-6)


def plain_square(texts, queries, n_parts):
    """A'A of all documents' windows, counted one by one, and the words' weights."""
    n = len(queries.known)
    found = [[queries.known.get(w, n) for w in decontamination.words(t)] for t in texts]
    times = np.bincount([w for f in found for w in set(f)], minlength=n + 1)[:n]
    idf = np.log((len(texts) + 1) / (times + 1)) + 0.01
    rows_ = [np.bincount(f[a : a + 32], minlength=n + 1)[:n] * idf for f in found for a in range(0, len(f), 32)]
    rows_ = np.array([r / np.linalg.norm(r) for r in rows_ if r.any()])
    return rows_.T @ rows_ * n_parts / len(rows_), idf


def test_space_is_fitted_on_all_windows_of_all_documents(spark):
    """What only some windows of a document hold counts, and so does each repetition in a window."""
    items = [(i, prose(f"fit{i}", 40, 300)) for i in range(30)]
    held = [" ".join(prose((i, k).__repr__(), 30 + i % 50, 60 + 20 * k) for k in range(9)) for i in range(60)]
    texts = [*held, None, "", "nothing known", f"{items[0][1].split()[0]} " * 2000]
    queries = decontamination._queries(docs(spark, texts), [(i, t, None) for i, t in items], 24, decontamination.Limits())
    plain, idf = plain_square(texts, queries, len(queries.parts))
    own = np.array([np.bincount(p, minlength=len(idf)) * idf for p in queries.parts])
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    whole = plain + own.T @ own
    space = queries.space[:-1] / idf[:, None]
    assert np.allclose(queries.weights, idf**2)
    best = np.linalg.eigvalsh(whole)[::-1][:24]
    assert np.allclose(np.linalg.norm(space, axis=0), 1, atol=1e-4)
    assert np.trace(space.T @ whole @ space) >= 0.98 * best.sum()
    assert np.allclose(np.einsum("ij,ik,kj->j", space, whole, space)[:4], best[:4], rtol=0.01)


@pytest.mark.parametrize("n_words", [50, 70_000])
def test_squared_windows(spark, monkeypatch, n_words):
    """The jobs' A'A times a basis is the plain one, for small and large vocabularies and cut rows."""
    monkeypatch.setattr(decontamination, "PACKED", 7)
    texts = [prose(f"sq{i}", 20 + 31 * i, 90) for i in range(12)] + [None]
    words = sorted({w for t in texts[:6] for w in decontamination.words(t)})
    known = {w: i for i, w in enumerate([*words, *(b"~%d" % i for i in range(n_words - len(words)))])}
    corpus = decontamination._corpus(docs(spark, texts), known)
    n = len(known)
    basis = np.random.default_rng(1).standard_normal((n, 5))
    found = [[known.get(w, n) for w in decontamination.words(t)] for t in texts]
    windows = [np.array(f[a : a + 32]) for f in found for a in range(0, len(f), 32)]
    idf = np.linspace(0.5, 3, n)
    wanted = np.zeros_like(basis)
    for window in windows:
        own, times = np.unique(window[window < n], return_counts=True)
        if len(own):
            row = times * idf[own] / np.linalg.norm(times * idf[own])
            wanted[own] += np.outer(row, row @ basis[own])
    assert corpus.n_docs == len(texts) and corpus.n_windows == sum((w < n).any() for w in windows)
    assert corpus.times.tolist() == np.bincount([w for f in found for w in set(f)], minlength=n + 1)[:n].tolist()
    assert np.allclose(corpus.squared(basis, idf), wanted, atol=1e-4)


def test_pipeline_stage_fits_on_all_documents(spark, planted, tmp_path, monkeypatch):
    """The stage's space is fitted on each window of each document, also beyond 2,000 documents."""
    texts = [prose(f"stage{i}", 40 + i % 60) for i in range(2500)]
    planted[1].write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, fit = [], decontamination._corpus
    monkeypatch.setattr(decontamination, "_corpus", lambda *a: seen.append(fit(*a)) or seen[-1])
    kept = corpus_pipeline.benchmark_stage(spark, docs(spark, texts), str(tmp_path))
    known = {w for b in planted[3].values() for w in decontamination.words(b)}
    cut = [decontamination.words(t)[a : a + 32] for t in texts for a in (0, 32, 64, 96)]
    assert [c.n_docs for c in seen] == [2500]
    assert [c.n_windows for c in seen] == [sum(not known.isdisjoint(c) for c in cut)]
    assert kept.count() == 2500 and kept.columns == docs(spark, []).columns


def test_blocks_of_items(planted, monkeypatch):
    df, items, wanted, _, _ = planted
    monkeypatch.setattr(decontamination, "BLOCK", 25)
    found = {(r.doc_id, r.item_id) for r in decontamination.matches(df, items).collect()}
    assert len(found & set(wanted.items())) >= 0.95 * len(wanted)


def test_items_of_null_and_text_ids_are_searched_for(spark):
    a, b = prose("null id", 30), prose("text id", 30)
    df = docs(spark, [f"{prose(1, 50)} {a}", f"{prose(2, 50)} {b}", prose(3, 80)])
    items = spark.createDataFrame([(None, a), ("b-2", b)], "item_id string, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.matches(df, items).collect()} == {(1, None), (2, "b-2")}
    assert ids(decontamination.decontaminated(df, items)) == [3]


def test_decontamination_odd_and_empty(spark, planted):
    df, items = odd(spark), planted[1]
    assert ids(decontamination.decontaminated(df, items)) == ALL_IDS
    assert decontamination.decontaminated(df, items).columns == df.columns
    assert decontamination.matches(df, items).collect() == []
    none = items.where("false")
    assert decontamination.matches(df, none).collect() == []
    assert decontamination.decontaminated(df, none).count() == len(ALL_IDS)
    assert decontamination.matches(empty(spark), items).collect() == []
    own = spark.createDataFrame([(1, prose(2, 30_000)[5000:5400])], "item_id long, text string")
    assert {r.doc_id for r in decontamination.matches(df, own).collect()} == {(1 << 60) + 1}


# Secrets

BASE = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    r"AKIA[A-Z0-9]+",
    r"[0-9a-f]+",
)


def plain_base(text):
    out = []
    for kind, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            size = len(m.group(2)) if kind == 0 else m.end() - m.start()
            if size >= (6, 20, 24)[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def model():
    windows = [w for i in range(150) for w in secrets.training_windows(str(i), prose(f"s{i}", 80))]
    return secrets.fitted(windows)


def test_base_spans_equal_the_patterns(spark, model):
    rng = random.Random(2)
    parts = ["password", "PASSWD", "ſecret", "secret", "toKen", "token", "api_key", "apiKey", " ", ":", "=", "'", '"', "\n",
             "abc", "deadbeef" * 3, "AKIA" + "A1" * 8, "AKIA", "é", "😀", "Zx9_/+=", "12345", "0" * 30]
    texts = ["".join(rng.choice(parts) for _ in range(40)) for _ in range(200)] + [None, ""]
    for r in secrets.report(docs(spark, texts), model=model).collect():
        base = plain_base(texts[r.doc_id - 1])
        listed = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert {s for s in r.spans.split(",") if s and not s.startswith("field")} == set(filter(None, listed.split(",")))


def test_decoding_is_exact(model):
    """Where only warm surroundings are decoded, the result is that of the whole text."""
    tagger = secrets.Tagger(model)
    for i in range(60):
        rng = random.Random(i)
        words = prose(f"d{i}", 200).split()
        for _ in range(rng.randrange(5)):
            words.insert(rng.randrange(len(words)), rng.choice(["password:", "Zx81kLmPq09vbn", "4111111111111111", "key", "=", "a.b@c.example.com"]))
        found = [w.encode() for w in words]
        mine = tagger.tags(found)
        kind = np.fromiter(map(tagger.memory.__getitem__, found), np.int64, len(found))
        side = np.concatenate([[0, 0], tagger.classes[kind], [0]])
        p, q, r = tagger.sides
        score = tagger.own[kind] + p[side[1:-2]] + q[side[:-3]] + r[side[3:]]
        score = score + model.of(secrets._file(float(tagger.odd[kind].mean())))
        whole = secrets.viterbi(score, model, True, True)
        assert (np.zeros(len(found)) if mine is None else mine).tolist() == whole


def test_field_finds_held_out_secrets(model):
    """Generated secrets outside of any base pattern, and harmless numbers, none of them trained on."""
    tagger = secrets.Tagger(model)
    hit = wrong = 0
    for i in range(200):
        rng = random.Random(f"held {i}")
        words = prose(f"h{i}", 40).split()
        secret = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randrange(16, 30)))
        at = rng.randrange(40)
        text = " ".join(words[:at] + ["credential", "=", secret] + words[at:])
        hit += any(text[a:b] == secret for a, b, _ in secrets.scan(text, tagger))
        number = secrets._filled(rng.choice(secrets._HARMLESS), rng)
        wrong += bool(secrets.scan(" ".join(words[:at] + [number] + words[at:]), tagger))
    assert hit >= 190 and wrong <= 6


def test_secrets_odd_and_empty(spark):
    got = rows(secrets.report(odd(spark)))
    assert len(got) == len(ALL_IDS) and (got.n_access == 0).all()
    assert got[got.doc_id.isin([1, 2, 3])].spans.eq("").all()
    assert secrets.report(empty(spark)).collect() == []
