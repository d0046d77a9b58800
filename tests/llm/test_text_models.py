"""Collocations, prefix tries and language-model scores against brute force, on small tables with edge cases."""

import dataclasses
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from wayfarer.llm import causal_attention, op11_collocations, op12_prefix_trie, op13_scoring, textbytes  # noqa: E402
from wayfarer.llm.word_pieces import WordPieces  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, word string, n long, uid long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " ", "\t \t", "a", "A. b!", ". . .", "one\ntwo\rthree", "é" * 30, "x" * 3000, "a\u0000b c", "  two   spaces\there ", "nb sp  x y ", "日本語 テキスト 🙂"]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "own", 0, 0) for i, t, lang in rows], DOC)


def salad(n, seed=1, words="the of red big old cat dog ran sat up".split(), most=60):
    r = random.Random(seed)
    return ["".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", ", "]) for _ in range(r.randint(0, most))) for _ in range(n)]


# -- collocations ----------------------------------------------------------------------------------


def brute_collocations(rows, least=10, top=2000, covered=50):
    f = {}
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    key = (lang or "und", tuple(w[i : i + k]))
                    f[key] = f.get(key, 0) + 1
    n = Counter()
    for (lang, g), c in f.items():
        n[lang] += c * (len(g) == 1)
    out = []
    for (lang, g), a in f.items():
        if len(g) < 2 or a < least:
            continue
        if len(g) == 2 and any(len(h) == 3 and g in (h[:2], h[1:]) and c >= least and 100 * c >= covered * a for (other, h), c in f.items() if other == lang):
            continue
        score, k = min((1000000 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
        out.append((lang, " ".join(g), a, f[lang, g[:k]], f[lang, g[k:]], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks = Counter()
    ranked = []
    for r in out:
        ranks[r[0]] += 1
        if ranks[r[0]] <= top:
            ranked.append((r[0], ranks[r[0]], *r[1:]))
    return ranked


@pytest.mark.parametrize("modulus", [1, 3, 12, 10**9])
def test_collocations_are_brute_force(spark, modulus):
    texts = salad(140) + ODD + ["the big red cat " * 40] * 3
    rows = [(i, t, ("en", "de", None, "und")[i % 4]) for i, t in enumerate(texts)]
    p = op11_collocations.CollocationParams(top=25)
    got = [tuple(r) for r in op11_collocations.collocations(documents(spark, rows), p, modulus).collect()]
    want = brute_collocations([(t, lang) for _, t, lang in rows], top=25)
    assert sorted(got) == sorted(want) and {"en", "de", "und"} == {r[0] for r in got}


def test_no_collocations_without_words(spark):
    assert op11_collocations.collocations(documents(spark, [])).count() == 0
    assert op11_collocations.collocations(documents(spark, [(i, t, None) for i, t in enumerate(ODD)])).count() == 0


def test_long_texts_are_parsed_in_runs(spark):
    r = random.Random(4)
    words = [r.choice("alpha beta gamma delta epsilon".split()) for _ in range(4000)]
    one = " ".join(words)  # a single piece, longer than a run
    many = ". ".join(" ".join(words[i : i + 7]) for i in range(0, 4000, 7)) + " " + "y" * 900
    for text in (one, many):
        docs = documents(spark, [(1, text, "en")])
        for limit in (200, 1 << 20):
            chunks = op11_collocations.dictionary(docs, 5, limit)
            for k in (1, 2, 3):
                got = {x["phrase"]: x["f"] for x in op11_collocations.count_phrases(chunks, k).collect()}
                want = Counter()
                for piece in text.split("."):
                    w = piece.split()
                    want.update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
                assert got == dict(want)


def test_scores_pass_64_bits(spark):
    big = 4_000_000_000_000
    rows = spark.createDataFrame([("en", "a", 3 * big), ("en", "b", 2 * big)], "lang string, phrase string, f long")
    pairs = spark.createDataFrame([("en", "a b", big)], "lang string, phrase string, f long")
    (r,) = op11_collocations._scored(pairs, pairs.limit(0), rows).collect()
    assert (r["l"], r["r"], int(r["score"])) == (3 * big, 2 * big, 1000000 * big * big // (6 * big * big))


def test_chunks_share_two_words():
    text = b"a b c d e f g h i j. k l m a b c d"
    data = np.frombuffer(text, np.uint8)
    row, tail, chunk = op11_collocations.parse(data, np.array([0, len(data)]), modulus=2)
    parts = chunk.to_pylist()
    assert set(tail.tolist()) <= {0, 2} and len(parts) > 3 and set(row.tolist()) == {0}
    for (a, n), b in zip(zip(parts, tail, strict=True), parts[1:], strict=False):
        assert not n or a.split()[-2:] == b.split()[:2]


# -- prefix trie -----------------------------------------------------------------------------------

CONV = "conv_id long, turn long, role string, text string, depth long, node string"


def brute_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    convs = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    new = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        new[c] = convs.get(base, [])[:h] + own[h:]
    nodes = {}
    for c, turns in new.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        under = [k for k in nodes if k[: len(key)] == key]
        kids = [k for k in under if len(k) == len(key) + 1]
        ends = sorted(c for c in members if len(new[c]) == len(key))
        out.append((
            min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(kids), sum(not any(len(j) == len(k) + 1 and j[: len(k)] == k for j in under) for k in under),
            sum((len(nodes[k]) - 1) * len(k[-1][1]) for k in under if k), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out)


def trie(spark, rows):
    return sorted((tuple(r) for r in op12_prefix_trie.prefix_trie(spark.createDataFrame([(*r, 7, "own") for r in rows], CONV)).collect()), key=lambda r: r[:2])


def test_trie_is_brute_force(spark):
    r = random.Random(3)
    rows = []
    for c in [*range(0, 40), *range(100, 130), 205, -7, -150]:
        for turn in range(r.choice([0, 1, 2, 3, 5, 9, 9]) + (c % 100 == 0) * 3):
            rows.append((c, turn, r.choice(["user", "bot"]), r.choice(["hi", "yes", "no é"])))
    rows += [(3, None, None, None), (3, 1, "user", "x"), (3, 1, "user", "x"), (3, 1, "bot", "x"), (None, 1, "user", "lost")]
    assert trie(spark, rows) == brute_trie(rows)


def test_trie_of_long_and_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(op12_prefix_trie, "TOGETHER", 4)
    monkeypatch.setattr(op12_prefix_trie, "BLOCK", 3)
    rows = [(c, t, "user", f"t{t % 5}") for c in range(1000, 1040) for t in range(6)] + [(77, t, "user", f"t{t % 5}") for t in range(150)] + [(78, t, "user", f"t{t % 5}" if t != 90 else "other") for t in range(133)]
    assert trie(spark, rows) == brute_trie(rows)


def test_trie_without_turns(spark):
    assert trie(spark, []) == [] == trie(spark, [(None, 0, "user", "x")])
    # A conversation that loses all its turns ends at the root.
    alone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 1)
    assert trie(spark, [(alone, 0, "user", "x")]) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def test_queries_are_their_sql(spark, small):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    for m in (op11_collocations, op12_prefix_trie):
        for name, sql in m.SQL.items():
            df = m.QUERIES[name](spark, small)
            cols = sorted(df.columns)
            c = con.execute(sql)
            names = [x[0] for x in c.description]
            assert sorted(map(repr, ((tuple(r[k] for k in cols)) for r in df.collect()))) == sorted(map(repr, (tuple(r[names.index(k)] for k in cols) for r in c.fetchall())))


# -- language-model scores -------------------------------------------------------------------------

SMALL = causal_attention.AttentionParams(width=6, hidden=8, classes=20, window=8, stride=5, sample=300, epochs=2)


def test_base_scores_are_brute_force(spark):
    texts = salad(60, 7) + ODD + ["rare1 rare2 rare1"] * 3
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, "the cat", "en"), (5, texts[5], "en")]
    counts = Counter()
    for i, t, _ in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER)), None])
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for i, t, _ in rows:
        tokens = [*re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER)), None]
        held = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        want.append((i, held, len(tokens), sum(counts[x] > 0 for x in tokens), total, round(sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in tokens), 8)))
    for most in (0, 6, 1 << 18):
        got = op13_scoring.score(documents(spark, rows), SMALL, most=most).collect()
        assert sorted(map(repr, want)) == sorted(repr((*r[:5], round(r["base_score"], 8))) for r in got)
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
        same = [r["score"] for r in got if r["doc_id"] == 5]
        assert len(same) == 2 and same[0] == pytest.approx(same[1], rel=1e-5)


def test_scores_without_teaching_texts(spark):
    assert op13_scoring.score(documents(spark, []), SMALL).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = op13_scoring.score(documents(spark, [(held, "a b", "en")]), SMALL).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)


def plain_score(net, p, classes, shares, column, ids):
    """Every id from its own window, place by place."""
    w, total, places, at = net.w, 0.0, len(ids) - 1, 0
    while True:
        first = 0 if at == 0 else p.window - p.stride
        for t in range(first, min(p.window, places - at)):
            x = w["e"][net.local[ids[at : at + t + 1]]].astype(float)
            att = (x[-1] @ w["q"]) @ (x @ w["k"]).T / math.sqrt(p.width) + w["far"][t - np.arange(t + 1)]
            att = np.exp(att - att.max())
            h = np.tanh(x[-1] @ w["x"] + (att / att.sum()) @ (x @ w["v"]) @ w["a"] + w["b"])
            logits = h @ w["out"] + w["bias"]
            nxt, now = ids[at + t + 1], ids[at + t]
            total += logits[classes[nxt]] - math.log(np.exp(logits).sum()) + shares[classes[now], column[nxt]]
        if at + p.window >= places:
            return total
        at += p.stride


def test_windows_score_each_id_once():
    p = causal_attention.AttentionParams(width=5, hidden=7, classes=9, window=8, stride=5)
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 50, 40)
    classes = causal_attention.classes_of(counts, p.classes)
    pairs = np.array([3 * 40 + 7, 0 * 40 + 39])
    shares, column = causal_attention.log_shares(counts, classes, p.classes, pairs, np.array([5, 9]), p.faith)
    net = causal_attention.CausalAttention(p, 40)
    for k in net.w:
        net.w[k] = rng.normal(0, 0.5, net.w[k].shape).astype(np.float32)
    scorer = causal_attention.Scorer(net, classes, shares, column)
    seqs = [rng.integers(0, 40, n) for n in (1, 2, 7, 8, 9, 10, 14, 15, 33, 60)]
    ids, offsets = np.concatenate(seqs).astype(np.int32), np.cumsum([0, *map(len, seqs)])
    for calm in (scorer.calm, False):
        scorer.calm = calm
        got = scorer.totals(ids, offsets, block=3)
        for s, g in zip(seqs, got, strict=True):
            assert g == pytest.approx(plain_score(net, p, classes, shares, column, s) if len(s) > 1 else 0.0, rel=1e-4, abs=1e-4)
    # Shares of a class add up to one behind every class.
    for before in range(p.classes):
        assert np.bincount(classes, np.exp(shares[before, column].astype(float)), p.classes)[np.unique(classes)] == pytest.approx(1.0, rel=1e-5)


def test_gradients_are_differences():
    p = causal_attention.AttentionParams(width=4, hidden=5, classes=6, window=5)
    rng = np.random.default_rng(3)
    net = causal_attention.CausalAttention(p, 10)
    for k in net.w:
        net.w[k] = rng.normal(0, 0.5, net.w[k].shape)
    ids, target, weight = rng.integers(0, 10, (3, 5)), rng.integers(0, 6, (3, 5)), rng.integers(0, 2, (3, 5)).astype(float)
    _, g = net.gradients(ids, target, weight)
    for k, w in net.w.items():
        for i in rng.integers(0, w.size, 4):
            at, keep = np.unravel_index(i, w.shape), w.flat[i]
            loss = []
            for step in (1e-3, -1e-3):
                w[at] = keep + step
                loss.append(net.gradients(ids, target, weight)[0])
            w[at] = keep
            assert g[k][at] == pytest.approx((loss[0] - loss[1]) / 2e-3, rel=2e-2, abs=2e-4)


def test_every_window_teaches_once(spark, monkeypatch):
    p = dataclasses.replace(SMALL, sample=1, epochs=1)
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 60, n).astype(np.uint16) for n in [0, 1, 7, 8, 9, 16, 17, *rng.integers(1, 90, 80)]]
    rows = [(i, t.tobytes()) for i, t in enumerate(texts)] + [(3, texts[3].tobytes())] * 5
    teach = spark.createDataFrame(rows, "doc_id long, ids binary")
    counts, n = op13_scoring.id_counts(teach, p.window)
    classes = causal_attention.classes_of(counts, p.classes)
    read = np.bincount([op13_scoring.END_ID] * len(rows) + [i for _, t in rows for i in np.frombuffer(t, np.uint16).tolist()], minlength=op13_scoring.IDS)
    for shard, block in ((1 << 17, 1 << 13), (30, 11), (7, 3)):
        monkeypatch.setattr(op13_scoring, "SHARD", shard)
        monkeypatch.setattr(op13_scoring, "BLOCK", block)
        net, reads = op13_scoring.taught(teach, counts, classes, n, p)
        seen = np.flatnonzero(read)
        assert reads[net.local[seen]].tolist() == read[seen].tolist() and reads.sum() == read.sum()
        again, _ = op13_scoring.taught(teach.repartition(5, "ids"), counts, classes, n, p)
        assert all(np.allclose(net.w[k], again.w[k], rtol=1e-4, atol=1e-5) for k in net.w)
    assert sum(len(x) for x, _ in op13_scoring._blocks(teach.select("ids").toArrow().to_batches(), p)) == n


def test_whole_corpus_teaches_whatever_the_sample(spark):
    texts = ["a b c d e f g h " * 3, "h g f e d c b a " * 3, "a c e g b d f h " * 3]
    rows = [(i, texts[i % 3], "en") for i in range(60)]
    said = []
    for sample in (1, 20):
        p = dataclasses.replace(SMALL, sample=sample, epochs=1)
        said.append([r["score"] for r in op13_scoring.score(documents(spark, rows), p).orderBy("doc_id").collect()])
    assert said[0] == pytest.approx(said[1], rel=1e-5)


def test_training_beats_counts_on_held_out_rows(spark, small):
    rows = [r for r in op13_scoring.op13_lm_scores(spark, small).collect() if r["held_out"]]
    assert len(rows) > 10
    ids = op13_scoring.IDS
    worst = sum(r["n_tokens"] for r in rows) * -math.log10(ids)
    assert sum(r["score"] for r in rows) > worst * 1.6  # some two and a half ids a word, each far better than any id


def test_words_are_cut_as_the_library_does():
    pieces = WordPieces.of(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    words = ["plain", "don't", "x1,y2", ",", "...", "é", "日本語", " x", "x ", "a b", "🙂", "\x85"]
    ids, sizes = pieces.cut(" ".join(words), len(words))
    at = 0
    for w, n in zip(words, sizes.tolist(), strict=True):
        assert pieces.encoding.decode([int(i) for i in ids[at : at + n]]) == " " + w
        at += n
    assert at == len(ids) and pieces.cut("", 0)[0].size == 0


def test_commonest_words_are_cut_once(monkeypatch):
    pieces = WordPieces.of(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    common, cut = ["the", "don't", "日本語", "long" * 30], []
    model = op13_scoring.WordModel(pa.array(common), np.array([9, 8, 7, 6]), 1, 30, 9, 3)
    assert model.looked_up(pieces) is model.looked_up(pieces)
    monkeypatch.setattr(WordPieces, "cut", lambda self, joined, n, f=WordPieces.cut: cut.append(joined) or f(self, joined, n))
    for words in (["日本語", "rare", "the", "é", "the2", "long" * 30, "long" * 31], ["the"], ["rare"], []):
        cut.clear()
        at, flat, begin, size = model.looked_up(pieces).ids_of(pa.array(words, pa.string()), pieces)
        assert at.tolist() == [common.index(w) if w in common else -1 for w in words]
        assert cut == [" ".join(w for w in words if w not in common)]
        ids = [int(i) for b, n in zip(begin.tolist(), size.tolist(), strict=True) for i in flat[b : b + n]]
        assert pieces.encoding.decode(ids) == "".join(" " + w for w in words)


@pytest.mark.parametrize("kinds", [1, 2, 1 << 60])
def test_words_that_share_a_hash_are_told_apart(monkeypatch, kinds):
    monkeypatch.setattr(textbytes, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(kinds))
    common = ["a", "b", "cc", "dd", "e"]
    known = op13_scoring.Known(op13_scoring.WordModel(pa.array(common), np.ones(5), 0, 5, 5, 0), WordPieces.of(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    words = ["e", "x", "dd", "a", "yy", "cc", "b", "zzz"]
    assert known.places(pa.array(words)).tolist() == [common.index(w) if w in common else -1 for w in words]


def test_rare_words_are_joined_without_sorting_where_they_fit(spark, monkeypatch):
    found = spark.createDataFrame([(1, None, "a", 2), (2, None, "a", 1), (2, None, "b", 5), (2, b"", None, None)], "uid long, ids binary, word string, n long")
    counts = spark.createDataFrame([("a", 3), ("c", 1), ("z", 90)], "word string, c long")
    said = []
    for held in (1 << 20, 0):
        monkeypatch.setattr(op13_scoring, "HELD", held)
        got = op13_scoring.rare_words(found, counts, 9, 3)
        said.append(sorted((r["uid"], r["n_known"], round(r["known"], 9)) for r in got.collect()))
        hints = got._jdf.queryExecution().analyzed().toString()
        assert ("shuffle_hash" in hints) == (held > 0)
    assert said[0] == said[1] == [(1, 2, round(2 * math.log10(4), 9)), (2, 1, round(math.log10(4), 9))]


def test_runs_end_behind_the_bytes_that_part(monkeypatch):
    data = np.frombuffer(b"aa bb " + b"c" * 50 + b" dd", np.uint8)
    got = [bytes(data[a:b]) for a, b in textbytes.runs(data, textbytes.SPACES, 8)]
    assert b"".join(got) == bytes(data) and all(g.endswith(b" ") for g in got[:-1]) and b"c" * 50 + b" " in got
