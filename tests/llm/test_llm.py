"""The training-data operators against brute force, round trips and edge cases."""

import hashlib
import itertools
import random
import re
import uuid

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loanlens.llm import chroma, copies, decontaminate, language, licenses, packing, privacy, sharding, simhash, toxicity, warc
from loanlens.operators.graph import components

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, n string, term string, pos int, h int"
ODD = ["", None, "  ", "...", "One", "a b c " * 3000, "same text here", "same text here", "é ß ñ", "\x00   x"]


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def frame(spark, texts, ids=None):
    rows = [(i, t, "x", "y", 1, 2) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, DOCS)


def test_decontaminate_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["the", "of", "a", "is", "red", "blue", "Fox", "ant", "Bee", "cow"]
    items = [" ".join(rng.choices(vocabulary, k=k)) for k in (1, 2, 3, 5, 12, 14, 11)] + ["", None, "the the the"]
    texts = ODD + [" ".join(rng.choices(vocabulary, k=rng.randint(0, 120))) for _ in range(60)] + [f"x, {items[5]}! {items[6]}", items[4].upper()]
    ids = [*range(len(texts) - 1), None]
    got = decontaminate.decontaminate(frame(spark, texts, ids), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    windows = {}
    for i, t in enumerate(items):
        ws = WORD.findall(lower(t))
        for k in range(max(1, len(ws) - 9) if ws else 0):
            windows.setdefault(tuple(ws[k : k + 10]), set()).add(str(i))
    assert len(got) == len(texts)
    want = {}
    for i, t in zip(ids, texts):
        ws, hit, its = WORD.findall(lower(t)), set(), set()
        for w, who in windows.items():
            for k in range(len(ws) - len(w) + 1):
                if tuple(ws[k : k + len(w)]) == w:
                    hit |= set(range(k, k + len(w)))
                    its |= who
        want[i] = (len(ws), len(hit), sorted(its), bool(hit))
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in got} == want


def test_proximity(spark):
    tests = decontaminate.build_tests(spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string"))
    texts = ["gamma x x alpha x beta", "alpha " + "x " * 40 + "beta gamma", "alpha beta"]
    found = decontaminate.proximity_matches(tests, decontaminate.build_index(frame(spark, texts), tests), 3, 6)
    assert {r.doc_id for r in found.collect()} == {0}


def test_near_matches_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["the", "of", "red", "blue", "Fox", "ant", "cow", "sky"]
    items = [" ".join(rng.choices(vocabulary, k=k)) for k in (2, 4, 5, 9, 10, 26)] + ["", None, "unseen words only once here"]
    texts = ODD + [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(30)]
    for t in items[3:6] * 6:
        ws = t.split()
        for k in rng.sample(range(len(ws)), max(1, len(ws) // 10) + rng.randint(0, 2)):
            ws[k] = "changed"
        texts.append("before " + " ".join(ws) + " after")
    ids = [*range(len(texts) - 1), None]
    rows = decontaminate.decontaminate_loosely(frame(spark, texts, ids), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    want = {}
    for i, t in zip(ids, texts):
        ws, want[i] = WORD.findall(lower(t)), set()
        for j, item in enumerate(items):
            xs = WORD.findall(lower(item))
            for x in (xs[k : k + 10] for k in range(max(1, len(xs) - 9) if xs else 0)):
                if any(sum(a == b for a, b in zip(x, ws[k:])) * 5 >= 4 * len(x) for k in range(-2, len(ws)) if k >= 0) or any(
                    sum(a == b for a, b in zip(x[k:], ws)) * 5 >= 4 * len(x) for k in (1, 2)
                ):
                    want[i].add(str(j))
    assert len(rows) == len(texts) and {r.doc_id: set(r.near_items) for r in rows} == want
    assert all(r.near == bool(r.near_items) and set(r["items"]) <= set(r.near_items) for r in rows)
    assert any(r.near and not r.contaminated for r in rows) and any(r.proximity_items for r in rows)


def test_pipeline_drops_changed_passages(spark, tmp_path):
    import corpus_pipeline

    item = "every one of these twenty words differs from all others in this item so that any window can be told apart".split()
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    changed = [w if i not in (4, 14) else "changed" for i, w in enumerate(item)]
    kept = corpus_pipeline.benchmark_decontamination(spark, frame(spark, ["x " + " ".join(changed), "from all others in this", " ".join(item)]), str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {1}


def test_empty_tables(spark):
    none, items = frame(spark, []), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(none, items).count() == 0
    assert decontaminate.decontaminate(frame(spark, ["a"]), items).first().n_hit == 0
    assert packing.pack(none).count() == sharding.shard(none).count() == privacy.find(none).count() == 0
    assert simhash.near_duplicates(none).count() == licenses.scan(none).count() == 0
    model = language.train(none.withColumn("lang", F.lit("en")))
    assert language.predict(frame(spark, ["a", None]), model).filter("lang_pred = 'und' and score = 0").count() == 2
    assert chroma.align(none.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("pcm"))).count() == 0
    tox = toxicity.train(none.withColumn("toxic", F.lit(1)), none.withColumn("toxic", F.lit(1)))
    assert toxicity.score(frame(spark, ["a", None]), tox).filter("score = 0").count() == 2


def test_language(spark):
    texts = [("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20 + [("???", "en"), (None, "de"), ("x", None)]
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(texts)], "doc_id long, text string, lang string")
    model = language.train(df)
    out = {r.doc_id: r for r in language.predict(frame(spark, ["the dog and cat", "die katze und hund", *ODD]), model).collect()}
    assert out[0].lang_pred == "en" and out[1].lang_pred == "de" and out[2].lang_pred == out[3].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in out.values()) and len(out) == 12
    long = "der hund und die katze " * 80_000
    assert language.score_texts([long], model)[0] == ["de"]


def test_toxicity(spark):
    rng = random.Random(1)
    plain = ["".join(rng.choices("aeiourstln", k=rng.randint(2, 7))) for _ in range(80)]
    rows = []
    for i in range(400):
        ws = rng.choices(plain, k=40)
        if i % 5 == 0:
            ws[7] = ws[20] = "zzyxgrump" + rng.choice(["", "er", "ing"])
        rows.append((i, " ".join(ws), int(i % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.filter("doc_id % 4 < 2"), df.filter("doc_id % 4 = 2"))
    out = toxicity.score(df.filter("doc_id % 4 = 3"), model).join(df.select("doc_id", "toxic"), "doc_id").collect()
    assert np.mean([(r.score >= 0.5) == (r.toxic == 1) for r in out]) > 0.95
    assert all(0 <= r.score <= 1 for r in toxicity.score(frame(spark, ODD), model).collect())


def test_toxicity_lower_order_is_a_distribution(spark):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcde", [9, 5, 3, 2, 1], k=rng.randint(2, 6))) for _ in range(20)) for _ in range(30)]
    df = spark.createDataFrame([(t, i % 2) for i, t in enumerate(texts)], "text string, toxic int")
    counts = toxicity.count(df)
    grams = {r.gram for r in counts.collect()}
    seen = [grams]
    for k in (4, 3, 2, 1):
        seen.append({g[1:] for g in seen[-1]})
    levels = {k: {} for k in (4, 3, 2, 1)}
    for longer, k in zip(seen, (4, 3, 2, 1)):
        for g in longer:
            levels[k][g[1:]] = levels[k].get(g[1:], 0) + 1
    d = lambda n: (0, 0.9, 1.4)[n] if n < 3 else 1.8

    def p(s):
        if not s:
            return 1 / len(levels[1])
        same = [c for t, c in levels[len(s)].items() if t[:-1] == s[:-1]]
        if not same:
            return p(s[1:])
        return (max(levels[len(s)].get(s, 0) - d(levels[len(s)].get(s, 0)), 0) + sum(map(d, same)) * p(s[1:])) / sum(same)

    got = {r.suffix: r.lower for r in toxicity.lower_order(counts).collect()}
    assert set(got) == set(levels[4]) and all(abs(got[s] - p(s)) < 1e-12 for s in got)
    h = max(got, key=levels[4].get)[:-1]
    assert abs(sum(p(h + x) for x in levels[1]) - 1) < 1e-9
    tables = toxicity.ratios(counts)
    assert len(tables.grams) == len(grams) and len(tables.contexts) == len({g[:4] for g in grams})


def test_toxicity_counts_the_rows_of_the_curve(spark):
    rows = [("plain words here", 0), ("nasty words here", 1)] * 4
    counted = spark.createDataFrame(rows, "text string, toxic int")
    held = spark.createDataFrame([*rows, ("zzyxgrump", 1)], "text string, toxic int")
    keys = set(toxicity.train(counted, held).ratios.grams.tolist())
    assert {g for p in toxicity._points("zzyxgrump") for g in toxicity._hashes(p, toxicity.ORDER).tolist()} <= keys


def test_simhash_against_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choices("abcdefghij", k=60)) for _ in range(30)]
    near = [" ".join(b.split()[:-1] + ["z"]) for b in base[:15]]
    texts = ODD + base + near + base[:3]
    want = []
    for t in texts:
        ws = (t or "").encode().lower().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(ws[k : k + 4]), 42) for k in range(max(1, len(ws) - 3))] if ws else []
        want.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    label = list(range(len(texts)))
    for _ in texts:
        for i, j in itertools.combinations(range(len(texts)), 2):
            if bin(want[i] ^ want[j]).count("1") <= 4:
                label[i] = label[j] = min(label[i], label[j])
    for block in (20_000, 2):
        got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(frame(spark, texts), block=block).collect()}
        assert got == {i: (want[i], label[i]) for i in range(len(texts))}


def test_near_copies_against_brute_force(spark):
    rng = random.Random(11)
    base = [" ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(rng.randint(30, 200))) for _ in range(12)]
    texts = [*ODD, *base, *(b.upper() for b in base[:3])]
    for b in base * 6:
        ws = b.split()
        for k in rng.sample(range(len(ws)), max(1, len(ws) // rng.choice([25, 35, 60, 100]))):
            ws[k] = "edited"
        texts.append("one very common line of words " * rng.randint(0, 1) + " ".join(ws))
    label, sets = list(range(len(texts))), [copies.shingles(t) for t in texts]
    for _ in texts:
        for i, j in itertools.combinations(range(len(texts)), 2):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                label[i] = label[j] = min(label[i], label[j])
    got = {r.doc_id: r.component_id for r in copies.near_copies(frame(spark, texts)).collect()}
    assert got == dict(enumerate(label))


def test_pipeline_drops_edited_copies(spark):
    import corpus_pipeline

    rng = random.Random(12)
    base = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(248)]
    edited = [w if i not in (40, 120, 200) else "edited" for i, w in enumerate(base)]
    kept = corpus_pipeline.near_duplicates(spark, frame(spark, [" ".join(base), " ".join(edited), "another text"]), "").collect()
    assert {r.doc_id for r in kept} == {0, 2}


def test_covering_masks():
    masks, rng = simhash.covering_masks(4), random.Random(2)
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
        assert any(not diff & m for m in masks)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, k) for k in range(900, 1000)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{k: 900 for k in range(900, 1001)}}


def base_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_privacy_base_spans(spark):
    rng = random.Random(4)
    bits = ["a@b.cd", "a@b.cd_x@y.zz", "a@b", "@@", "1.2.3.4.5", "300.1.1.1", "010.001.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (234) 567-8901", "+12", "++1 2345678", "é€", "𝒳", " ", ".", "-", "7"]
    texts = ODD + ["".join(rng.choices(bits, k=rng.randint(1, 9))) for _ in range(300)] + ["1" * 50_000, "a" * 50_000, "1 " * 30_000, "+1" * 9000]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.kind != "term"] for r in privacy.find(frame(spark, texts)).collect()}
    assert got == {i: base_spans(t or "") for i, t in enumerate(texts)}


def test_privacy_terms_and_redaction(spark):
    filler = [f"common words stand here number {i} with the usual rest" for i in range(30)]
    secret = [f"kingfisher of {i} wrote to bob@x.org with the usual" for i in range(3)]
    out = {r.doc_id: r.text for r in privacy.sanitise(frame(spark, filler + secret + [None])).collect()}
    assert all("bob@" not in out[i] and "kingfisher" not in out[i] and "[EMAIL]" in out[i] and "usual" in out[i] for i in (30, 31, 32))
    assert out[0] == filler[0] and out[33] is None


def test_packing(spark):
    rng = random.Random(6)
    for _ in range(100):
        lengths = rng.sample(range(1, 30), rng.randint(1, 7))
        counts, k = [rng.randint(1, 9) for _ in lengths], rng.randint(1, 4)
        cost = lambda bs: sum(c * min(b for b in bs if b >= x) for x, c in zip(lengths, counts))  # noqa: B023, E731
        best = min(cost(bs) for r in range(1, k + 1) for bs in itertools.combinations(lengths, r) if max(bs) == max(lengths))
        got = packing.boundaries(np.array(lengths), np.array(counts), k)
        assert cost(got) == best and len(got) <= k
    texts = ODD + ["w " * rng.randint(0, 400) for _ in range(150)]
    rows = packing.pack(frame(spark, texts), max_tokens=100, buckets=3, budget=300).collect()
    for i, t in enumerate(texts):
        own = sorted((r.start, r.n_tokens) for r in rows if r.doc_id == i)
        assert own[0][0] == 0 and sum(n for _, n in own) == len((t or "").encode().split()) + 1
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
    batches = {}
    for r in rows:
        assert r.n_tokens <= r.boundary
        batches.setdefault((r.boundary, r.batch), []).append(r.place)
    for (b, _), places in batches.items():
        assert sorted(places) == list(range(len(places))) and b * len(places) <= max(300, b)
    assert len({b for b, _ in batches}) <= 3


def test_sharding(spark):
    df = frame(spark, ODD + [f"t{i}" for i in range(3000)])
    rows = sharding.shard(df, 8).collect()
    assert all(r.grown_shard in (r.shard, 8) for r in rows)
    moved = sum(r.grown_shard == 8 for r in rows) / len(rows)
    assert 0.08 < moved < 0.15
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    first = {r.doc_id: r for r in rows}
    assert first[1].size == 1 and first[1].text_crc32 == 0 and first[8].size == len(ODD[8].encode()) + 1
    heavy = sharding.shard(df, weights=[3.0, 1.0]).filter("shard = 0").count() / len(rows)
    assert 0.7 < heavy < 0.8


@pytest.mark.parametrize("chunk", [1 << 18, 700])
def test_warc_round_trip(spark, tmp_path, chunk):
    mark = "\r\n\r\nWARC/1.0\r\n"
    rows = [(1, "u", "x" * 1500), (2, None, "x" * 1500), (3, "u\r\nz", "short"), (4, "u", "short"), (5, "u", None), (6, "u", "é" * 3000 + mark + "foo" + mark), (7, "u", mark)]
    rows += [(8, "u", "y" * 999), (9, "u", "y" * 999), (10, "u", "WARC/1.0\r\nabc"), (11, "u", "tail\r\n\r\n"), (12, "u", "\r\n"), (12, "u", "\r\n"), (None, "u", "nul"), (14, "u", ("a" + mark) * 300), (15, "u", mark[:-2])]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "record_id long, uri string, payload string, type string, data int")
    path = str(tmp_path / uuid.uuid4().hex)
    warc.write(df, path, chunk=chunk)
    want = []
    for i, _, t in rows:
        b = (t or "").encode()
        top = max(j for j, _, x in rows if (x or "") == (t or "") and j is not None) if i is not None else None
        revisit = i is not None and len(b) >= 1000 and top != i
        want.append((None if i is None else str(i), len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", str(top) if revisit else None))
    assert sorted(map(tuple, warc.read(spark, path).collect()), key=str) == sorted(want, key=str)


def test_licence_automaton():
    s, rng = licenses.Scanner(), random.Random(1)
    templates = [licenses.tokens(t) for t in [x for _, x in licenses.TEMPLATES] + list(licenses.BASE_PHRASES)]
    strings = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for _ in range(80):
        words = []
        while len(words) < 40:
            t = rng.choice(templates)
            i = rng.randrange(len(t))
            words += t[i : i + rng.randint(1, 6)] if rng.random() < 0.6 else [b"zzz"]
        got = {i: n for i, _, n in s.automaton.statistics(iter([words[:17], words[17:]]))}
        for i in range(len(words)):
            assert got.get(i, 0) == max(k for k in range(i + 2) if k == 0 or tuple(words[i - k + 1 : i + 1]) in strings)


def test_licence_scan(spark):
    texts = [*ODD, "cc by CC-BY all rights reserved", "x GNU General Public License. cc by", "Released under the MIT License.", "the licence of the version " * 500]
    out = {r.doc_id: r for r in licenses.scan(frame(spark, texts)).collect()}
    phrases = [p.split() for p in licenses.BASE_PHRASES]
    for i, t in enumerate(texts):
        ws = WORD.findall(lower(t))
        want = sorted(k for p in phrases for k in range(len(ws)) if ws[k : k + len(p)] == p)
        assert sorted(s.start for s in out[i].spans if s.base) == want and out[i].n_words == len(ws)
    assert {s.label for s in out[len(ODD) + 2].spans} == {"mit"}


def test_chroma(spark):
    rng = np.random.default_rng(3)
    tune = lambda n: ((128 + 60 * np.sin(np.cumsum(np.repeat(2 * np.pi * 110 * 2 ** (rng.integers(0, 36, n) / 12) / 8000, 400)))).astype(np.uint8)).tobytes()
    songs = [tune(40) for _ in range(8)]
    late = songs[0][64 * 10 :]
    rows = [(i * 50, s) for i, s in enumerate(songs)] + [(1, songs[0]), (2, late), (3, b""), (4, None), (7, songs[3] + tune(10))]
    out = {r.id: r for r in chroma.align(spark.createDataFrame(rows, "id long, pcm binary")).collect()}
    assert out[1].class_id == 0 and out[3].class_id == out[4].class_id == 3
    assert out[2].n_links == 1 and out[2].best_class == 0 and out[2].best_offset == -10
    assert out[7].n_links == 1 and out[7].best_class == 150 and out[50].n_links == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    en, de = "the of and to in is that for with was".split(), "der die und das mit von ist nicht ein auf".split()
    texts = [(" ".join(rng.choices(en if i % 2 else de, k=80)), "en" if i % 2 else "de") for i in range(40)]
    texts += [texts[0], ("???", "en"), (None, "en"), (" ".join(en * 2), "en"), ("the mail of bob@x.org and that was in", "en")]
    df = spark.createDataFrame([(i, t, x, "s", len(t or "")) for i, (t, x) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(en))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns, name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept) == set(range(40)) | {44} and "bob@" not in kept[44]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(kept)
