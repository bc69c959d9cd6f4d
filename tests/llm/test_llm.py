"""The training-text operators against brute force, exact round trips and held-out rows, and their odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.oracle import assert_same
from tracewright.llm import exact_dedup, langid, licenses, mixing, order_minhash, packing, pii, quality, queries, vector_graph, wordpiece
from tracewright.llm.bpe_ids import WordIds
from tracewright.llm.shared import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, norm string, key string, mix_slot long, lang_pred string"


def docs(spark, rows):
    """Rows of (id, text) or (id, text, lang, source), with columns whose names clash with the operators' own."""
    full = [(r[0], r[1], *(r[2:] or ("en", "s")), 0, 1, "n", "k", 7, "x") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "same text"), (4, "same text"), (5, "sametext "), (6, "x" * 200_000), (None, "no id"), (7, "1" * 3_000 + "@" * 3_000 + "a." * 3_000), (8, None)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF)


def test_exact_dedup_odd_and_hot(spark):
    hot = [(100 + i, "hot copies of one text" + " " * (i % 3)) for i in range(400)]
    near = [(1000 + i, "hot copies of one text, edited " + str(i)) for i in range(300)]
    rows = ODD + hot + near
    got = exact_dedup.exact_dedup(docs(spark, rows), buckets=16).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    want = Counter()
    for norm, own in groups.items():
        keep = min((-len(t), i) for i, t in own if i is not None)[1] if any(i is not None for i, _ in own) else None
        for i, _ in own:
            want[(i, keep, len(own), i is not None and i == keep, hashlib.sha256(norm.encode()).hexdigest())] += 1
    assert Counter(map(tuple, got)) == want
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0
            fits = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}
            if fits[kind]:
                out.append((m.start(), k, m.end(), kind))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


def test_pii_base_spans_like_the_patterns(spark, table):
    draw = random.Random(2)
    odd = [(i, "".join(draw.choice(["a", "é", "@", ".", "1", "4", "22", " ", "-", "+1", "(", ")", "_", "255", "x@y.z"]) for _ in range(60))) for i in range(300)]
    hexes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(80)]
    told = [(7_000 + i, f'le token = "{h}" et') for i, h in enumerate(hexes[:40])] + [(8_000 + i, f"le {h} et") for i, h in enumerate(hexes[40:])]
    rows = [(i, t) for i, t in ODD[:6]] + told + [(900, "a@b.c_x@d.e ip 001.2.3.4.5.6.7.8 4111 1111 1111 1111 +1 (523) 555-1055")] + odd + [(r.doc_id + 5000, r.text) for r in table.collect()]
    found = pii.find_pii(docs(spark, rows)).collect()
    want = Counter((i, hashlib.sha256(",".join(base_spans(t or "")).encode()).hexdigest()) for i, t in rows)
    assert Counter((r.doc_id, r.base_sha256) for r in found) == want
    spans = {r.doc_id: r.spans.split(",") for r in found}
    assert all(set(base_spans(t or "")) <= set(spans[i]) for i, t in rows)
    secrets = [(i, m.span(1)) for i, t in rows for m in re.finditer(r'token = "([0-9a-f]{40})"', t or "")]
    assert secrets and all(f"secret:{a}:{b}" in spans[i] for i, (a, b) in secrets)
    text = pii.redact(docs(spark, [(900, "mail a@b.c now")]), spark.createDataFrame([(900, "email:5:10")], "doc_id long, spans string")).first().text
    assert text == "mail [email] now"
    assert pii.find_pii(docs(spark, [])).count() == 0


def test_pii_of_a_megabyte_of_digits(spark):
    import time

    rows = [(1, "7" * 1_000_000), (2, "a@b.c " * 60_000), (3, "x=" + "Ab1+" * 200_000)]
    began = time.perf_counter()
    got = {r.doc_id: r for r in pii.find_pii(docs(spark, rows)).collect()}
    assert time.perf_counter() - began < 120 and got[2].n_email == 60_000 and got[1].n_card == got[1].n_ip == 0
    assert got[2].spans.endswith(f"email:{6 * 59_999}:{6 * 59_999 + 5}")


def check_packed(spark, rows):
    got = packing.pack(docs(spark, rows)).collect()
    encoder = WordIds(packing.default_tokenizer()).tokenizer
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append(np.array([*encoder.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, own in ids.items():
        want = Counter((s, min(2048, len(x) - s), zlib.crc32(x[s : s + 2048].tobytes()), len(x)) for x in own for s in range(0, len(x), 2048))
        assert Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces[i]) == want
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    return sum(map(len, (x for own in ids.values() for x in own))) / (2048 * max(1, len(sequences)))


def test_packing_round_trip(spark, table):
    odd = [(1, None), (2, ""), (3, "a <|endoftext|> b"), (3, "again\x1ccontrol"), (None, "no id"), (4, "Σίσυφος İ ﬁ é don't"), (5, "word, " * 5_000)]
    check_packed(spark, odd)
    assert check_packed(spark, [(r.doc_id, r.text) for r in table.collect()]) > 0.95
    assert packing.pack(docs(spark, [])).count() == 0


def test_cutting_plan_uses_up_the_demand():
    draw = np.random.default_rng(0)
    for n in (1, 7, 3_000):
        demand = np.bincount(draw.integers(1, 65, n), minlength=65)
        plan = packing.cutting_plan(demand)
        assert (sum(p * k for p, k in plan) == demand).all() and all((p * np.arange(65)).sum() <= 64 for p, _ in plan)
    assert sum(k for _, k in plan) <= 1.02 * (demand * np.arange(65)).sum() / 64 + 1


def greedy(pieces, s):
    i = n = 0
    while i < len(s):
        i = next((j for j in range(len(s), i + 1, -1) if s[i:j] in pieces), i + 1)
        n += 1
    return n


def test_longest_match_automaton_like_greedy():
    draw = random.Random(3)
    for _ in range(800):
        vocab = {"".join(draw.choice("abc") for _ in range(draw.randint(1, 5))) for _ in range(draw.randint(1, 8))}
        word = "".join(draw.choice("abcd") for _ in range(draw.randint(0, 14)))
        assert wordpiece.Automaton(sorted(vocab)).count(word) == greedy(vocab, word)


def test_token_counts_like_greedy(spark, table):
    import regex

    pieces, symbols, memo = set(wordpiece.vocabulary(packing.default_tokenizer())), wordpiece.byte_symbols(), {}

    def count(word):
        if word not in memo:
            s = [symbols[b] for b in word.encode()]
            s[-1] = chr(ord(s[-1]) + wordpiece.LAST)
            memo[word] = greedy(pieces, "".join(s))
        return memo[word]

    rows = [(r.doc_id, r.text) for r in table.limit(60).collect()] + [(-1, None), (-2, ""), (None, "it's 42 Σ!")]
    got = {r.doc_id: r.n_tokens for r in wordpiece.count_tokens(docs(spark, rows)).collect()}
    assert got == {i: sum(count(w) for c in (t or "").split() for w in regex.findall(wordpiece.WORD, c.lower())) for i, t in rows}


def words_of(text):
    return re.findall(r"[^\W_]+", text.lower())


def alignment(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1] / (len(a) + len(b) - row[-1])


def test_alignment_like_dynamic_programming():
    draw = random.Random(9)
    for _ in range(300):
        a = [draw.choice("abcdefgh") for _ in range(draw.randint(1, 40))]
        b = [c for c in a if draw.random() > 0.06] + [draw.choice("abcdefgh") for _ in range(draw.randint(0, 3))]
        if b:
            as_hashes = lambda w: np.array([ord(c) for c in w], np.uint64)
            assert order_minhash.similar(as_hashes(a), as_hashes(b)) == (alignment(a, b) >= 0.8 - 1e-12)


def test_deduplicated_rows(spark):
    hot = [(100 + i, "hot copies of one text" + " " * (i % 3)) for i in range(400)]
    rows = ODD + hot + [(None, "hot copies of one text  "), (None, "alone"), (None, "alone "), (9, "other"), (9, "another")]
    for buckets, least in ((16, 4), (4096, 8)):
        got = exact_dedup.deduplicated(docs(spark, rows), buckets=buckets, least=least)
        assert got.columns == docs(spark, []).columns
        want = {}
        for i, t in rows:
            norm, rank = re.sub(r"[\x20\x09-\x0D]", "", t or ""), (-len(t or ""), i is None, i or 0)
            if norm not in want or rank < want[norm][0]:
                want[norm] = rank, i, t or ""
        assert Counter((r.doc_id, r.text or "") for r in got.collect()) == Counter((i, t) for _, i, t in want.values())
    assert exact_dedup.deduplicated(docs(spark, [])).count() == 0


def test_pipeline_stages_choose_rows_not_ids(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(None, base), (None, base + " end"), (1, base + " other end"), (None, "quite another text"), (2, "the one"), (2, "the other"), (3, "the one ")]
    table = docs(spark, rows)
    for name, stage, want in [("exact dedup", corpus_pipeline.exact, [(None, base), (None, base + " end"), (None, "quite another text"), (1, base + " other end"), (2, "the other"), (3, "the one ")]), ("near", corpus_pipeline.near, [(None, "quite another text"), (1, base + " other end"), (2, "the one"), (2, "the other")]), ("mixing", corpus_pipeline.mix, rows)]:
        got = stage(spark, table, SF)
        assert got.columns == table.columns, name
        assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(want), name
        assert stage(spark, table.where("false"), SF).count() == 0


def test_sequences_follow_the_mixture(spark, tmp_path):
    draw = random.Random(4)
    rows = [(i, " ".join(f"w{draw.randrange(900)}" for _ in range(draw.choice([20, 60, 150, 400]))), "en", "abbcccc"[i % 7]) for i in range(4_000)]
    corpus_pipeline.mix(spark, docs(spark, rows), SF).write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    slots = {r.doc_id: r.mix_slot for r in mixing.mix(docs(spark, rows)).select("doc_id", "mix_slot").collect()}
    got = corpus_pipeline.pack(spark, mixed, SF).collect()
    first = {}
    for r in got:
        first[r.sequence_id] = min(first.get(r.sequence_id, 10**9), slots[r.doc_id])
    order = [first[k] for k in sorted(first)]
    assert np.corrcoef(order, range(len(order)))[0, 1] > 0.98
    source = {r[0]: r[3] for r in rows}
    half = Counter(source[r.doc_id] for r in got if r.sequence_id < len(first) // 3 for _ in range(r.length))
    counts = Counter(source.values())
    want = {s: n**0.5 / sum(m**0.5 for m in counts.values()) for s, n in counts.items()}
    assert all(abs(half[s] / half.total() - want[s]) < 0.08 for s in want)


def test_near_duplicates_keep_every_close_pair(spark, table):
    draw = random.Random(6)
    base = [f"w{draw.randrange(4000)}" for _ in range(220)]
    group = [(10_000 + i, " ".join("zz" if draw.random() < 0.004 else w for w in base)) for i in range(60)]
    passage = " ".join(f"p{i}" for i in range(60))
    shared = [(20_000 + i, passage + " " + " ".join(f"q{draw.randrange(10**6)}" for _ in range(70))) for i in range(60)]
    rows = [(r.doc_id, r.text) for r in table.collect()] + group + shared + [(30_000, None), (30_001, ""), (30_002, "!"), (30_003, "one two"), (30_004, "One, two!"), (None, "one two"), (10_000, group[0][1])]
    every = order_minhash.near_duplicates(docs(spark, rows)).collect()
    got = {r.doc_id: r for r in every if r.doc_id is not None}
    assert Counter(r.class_id for r in every if r.kept and r.class_id is not None) == Counter({r.class_id: 1 for r in every if r.class_id is not None})
    assert [(r.class_id, r.kept) for r in every if r.doc_id is None] == [(30_003, False)]
    sets = {i: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, t in rows if i is not None and (w := words_of(t or ""))}
    byshingle = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            byshingle[x].add(i)
    pairs = {(a, b) for own in byshingle.values() for a in own for b in own if a < b}
    close = [(a, b) for a, b in pairs if (sets[a] & sets[b]).total() >= 0.8 * (sets[a] | sets[b]).total()]
    assert len(close) > 100 and all(got[a].class_id == got[b].class_id for a, b in close)
    texts = dict(rows)
    for i, r in got.items():
        assert r.class_id <= r.copy_id <= i and (not r.kept or r.class_id == i)
    assert len({got[i].class_id for i, _ in shared}) == 60
    assert got[30_004].class_id == 30_003 and all(got[i].class_id == i for i in (30_000, 30_001, 30_002))
    for i, r in list(got.items())[:40]:
        if r.class_id != i:
            assert any(o.class_id == r.class_id and j != i and alignment(words_of(texts[i]), words_of(texts[j])) >= 0.8 for j, o in got.items())
    assert order_minhash.near_duplicates(docs(spark, [])).count() == 0


def test_scattered_edits_are_no_near_duplicates(spark):
    draw = random.Random(15)
    base = [f"w{i}" for i in range(200)]
    rows = [(100 + i, " ".join(f"x{i}q{k}" if k % 20 == i % 20 else w for k, w in enumerate(base))) for i in range(20)] + [(500, " ".join([*base[:198], "y1", "y2"])), (501, " ".join([*base[:197], "z1"]))]
    draw.shuffle(rows)
    words = {i: words_of(t) for i, t in rows}
    assert alignment(words[100], words[101]) > 0.8
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == {i: 500 if i >= 500 else i for i, _ in rows}


def test_components_like_union_find(spark):
    draw = random.Random(1)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(80)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for x in root}


def test_language_model_like_plain_loops(spark, table):
    """The weights against a loop over single coordinates, the temperature against a search, ids and languages unseen."""
    rows = [(langid.weighted(langid.counts_of(t), np.ones(1 << langid.BITS, np.float32)), y) for t, y in [("one of the many", 0), ("der und die das", 1), ("the other one", 0), ("das ist die und", 1)]]
    sparse = [(at, x, y) for (at, x), y in rows]
    w, b = langid._follow_the_leader(sparse, 1 << langid.BITS, 2, 2)
    z, n = defaultdict(float), defaultdict(float)
    order = np.random.default_rng(7)
    leader = lambda i, c: 0.0 if abs(z[i, c]) <= langid.L1 else -(z[i, c] - np.sign(z[i, c]) * langid.L1) / ((langid.BETA + n[i, c] ** 0.5) / langid.ALPHA + langid.L2)
    for _ in range(2):
        for k in order.permutation(len(sparse)):
            at, x, y = sparse[k]
            pairs = [*zip(at.tolist(), x.tolist(), strict=True), (1 << langid.BITS, 1.0)]
            said = [sum(v * leader(i, c) for i, v in pairs) for c in (0, 1)]
            e = np.exp(np.array(said) - max(said))
            p = e / e.sum()
            held = {(i, c): leader(i, c) for i, _ in pairs for c in (0, 1)}
            for i, v in pairs:
                for c in (0, 1):
                    g = v * (p[c] - (c == y))
                    sigma = ((n[i, c] + g * g) ** 0.5 - n[i, c] ** 0.5) / langid.ALPHA
                    z[i, c] += g - sigma * held[i, c]
                    n[i, c] += g * g
    assert all(abs(w[i, c] - leader(i, c)) < 1e-5 for at, *_ in sparse for i in at.tolist() for c in (0, 1))
    assert all(abs(b[c] - leader(1 << langid.BITS, c)) < 1e-6 for c in (0, 1))
    draw = np.random.default_rng(3)
    logits, ys = draw.normal(size=(200, 3)) * 4, draw.integers(0, 3, 200)
    loss = lambda t: -np.mean([np.log(np.exp(r[y] / t) / np.exp(r / t).sum()) for r, y in zip(logits, ys, strict=True)])
    best = min(np.geomspace(0.05, 5, 60), key=loss)
    assert abs(langid._temperature(logits, ys) - best) < 1e-9
    model = langid.fit(table)
    again = langid.fit(table.unionByName(table.where("crc32(string(doc_id)) % 4 = 2").selectExpr("doc_id", "text", "'xx' as lang", "source", "n_chars")))
    assert model.langs == again.langs and np.allclose(model.weights, again.weights)


def test_quality_vote_like_plain_neighbours(spark, table):
    model = quality.fit(table, spark.read.parquet(f"{SF}/labels.parquet").unionByName(spark.read.parquet(f"{SF}/labels.parquet")))
    texts = [r.text for r in table.limit(30).collect()] + ["", "x"]
    got = {(r.text or ""): r.quality_score for r in quality.score(docs(spark, list(enumerate(texts))), model).collect()}
    for t in texts:
        at, x = quality.weighted(quality.counts_of(t or ""), model.idf)
        v = np.zeros(model.basis.shape[1])
        for i, value in zip(at.tolist(), x.tolist(), strict=True):
            v += value * model.basis[i].astype(float)
        v /= max(np.linalg.norm(v), 1e-12)
        near = sorted(((float(v @ o), float(y)) for o, y in zip(model.voters, model.labels, strict=True)), reverse=True)
        kth = near[min(quality.NEIGHBOURS, len(near)) - 1][0]
        if sum(c > kth - 1e-4 for c, _ in near) == min(quality.NEIGHBOURS, len(near)):  # no tie for the last voice
            votes = [(np.exp(quality.SHARPNESS * (c - 1)), y) for c, y in near[: quality.NEIGHBOURS]]
            assert abs(got[t or ""] - sum(w * y for w, y in votes) / sum(w for w, _ in votes)) < 1e-3


def test_quality_held_out(spark, table):
    found = queries.QUERIES["op6_quality"](spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    held = found[found.held_out]
    assert len(held) and (held.predicted == held.quality).mean() > 0.9
    model = quality.fit(table, spark.read.parquet(f"{SF}/labels.parquet"))
    odd = quality.score(docs(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.quality_score <= 1 for r in odd)
    empty = quality.fit(table, spark.read.parquet(f"{SF}/labels.parquet").where("false"))
    assert quality.score(docs(spark, ODD[:2]), empty).first().quality_score == 0.5
    assert quality.score(docs(spark, []), model).count() == 0


def test_language_held_out(spark, table):
    found = queries.QUERIES["op8_language_id"](spark, SF).toPandas().merge(table.select("doc_id", "lang").toPandas(), on="doc_id")
    held = found[found.held_out]
    assert len(held) and (held.lang_pred == held.lang).mean() > 0.95
    model = langid.fit(table)
    odd = langid.identify(docs(spark, [*ODD, (9, "12 34 !!")]), model).collect()
    assert {r.lang_pred for r in odd if r.doc_id in (1, 2, 3, 8, 9)} == {"und"} and len(odd) == len(ODD) + 1
    assert langid.identify(docs(spark, ODD), langid.fit(docs(spark, []))).where("lang_pred <> 'und'").count() == 0


def test_vectors_like_brute_force(spark):
    draw = np.random.default_rng(8)
    base = draw.normal(size=(300, 16))
    near = base[:60] + 0.02 * draw.normal(size=(60, 16))
    tight = base[:1] + 0.05 * draw.normal(size=(50, 16))
    x = np.concatenate([base, near, tight, base[:5], 3 * base[5:8]]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    bad = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [None] + [1.0] * 15, 0), (1004, [1.0, 2.0], 0), (1005, [], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, shards int")
    got = {r.vec_id: r for r in vector_graph.link_vectors(df).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    there = linked.sum(axis=1) - 1
    recall = sum(min(got[i].n_links, n) for i, n in enumerate(there)) / there.sum()
    assert recall >= 0.9 and all(got[i].n_links <= n for i, n in enumerate(there))
    assert all(got[b[0]].n_links == 0 and got[b[0]].component_id == b[0] for b in bad)
    assert vector_graph.audit_recall(df.where("vec_id < 1000"), spark.createDataFrame([(r.vec_id, r.n_links) for r in got.values() if r.vec_id is not None], "vec_id long, n_links long"), every=5) >= 0.9
    assert vector_graph.link_vectors(df.where("false")).count() == 0 and vector_graph.link_vectors(df.where("vec_id = 1000")).first().kept


def test_vectors_of_several_lengths(spark):
    draw = np.random.default_rng(4)
    rows = [(i, [float(x) for x in draw.normal(size=2)]) for i in range(40)] + [(100 + i, [float(x) for x in draw.normal(size=3)]) for i in range(40)]
    rows += [(3, [1.0, 0.0, 0.0]), (4, [1.0, 0.0, 0.0]), (200, [1.0] * 5), (201, [2.0] * 5), (202, [1.0] * 7), (203, [1.0] * 7), (204, [1.0] * 9), (205, [])]
    rows = [r for r in rows if r[0] not in (3, 4) or len(r[1]) == 3]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_graph.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    near = {i: [j for j, y in rows if i != j and len(x) == len(y) > 0 and np.dot(x, y) >= 0.9 * np.linalg.norm(x) * np.linalg.norm(y)] for i, x in rows}
    group = {i: i for i in near}
    for _ in near:
        group = {i: min([group[i], *(group[j] for j in near[i])]) for i in near}
    assert got == {i: (len(near[i]), group[i], group[i] == i) for i in near} and got[4][1] == 3


def test_vectors_of_shards_over_the_limit(spark, monkeypatch):
    """Shards far over their limits are split by similarity, and large components are counted block by block."""
    for name, value in {"MOST_SHARDS": 2, "SHARD": 60, "MOST_IN_SHARD": 150, "BLOCK": 64, "DEALT": 500, "SPLIT_ROWS": 200}.items():
        monkeypatch.setattr(vector_graph, name, value)
    draw = np.random.default_rng(21)
    base = draw.normal(size=(1_000, 24))
    line = np.cumsum(draw.normal(size=(150, 24)) * 0.08, axis=0) + 3 * draw.normal(size=24)
    ball = draw.normal(size=24) + 0.02 * draw.normal(size=(300, 24))
    x = np.concatenate([base, base[:700] + 0.04 * draw.normal(size=(700, 24)), line, ball, np.outer(np.arange(1.0, 201.0), base[0]), [base[1] * 1e200, base[2] * 1e-200]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in vector_graph.link_vectors(df).collect()}
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    there = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= there).all() and found.sum() >= 0.97 * there.sum() and (found == there).mean() > 0.97


def test_vectors_of_large_groups_side_by_side(spark):
    draw = np.random.default_rng(12)
    d = 32
    first, other = np.eye(d)[0], 0.94 * np.eye(d)[0] + np.sqrt(1 - 0.94**2) * np.eye(d)[1]
    noise = draw.normal(size=(300, d)) * 0.1 / np.sqrt(d)
    x = np.repeat([first, other], 150, axis=0) + noise
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    assert linked[:150, 150:].mean() > 0.5 and np.sort(unit @ unit.T, axis=1)[:, -97].min() > (unit[:150] @ unit[150:].T).max()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in vector_graph.link_vectors(df).collect()}
    assert all(got[i].n_links == n and got[i].component_id == 0 for i, n in enumerate(linked.sum(axis=1) - 1))
    table = pa.table({"id": np.arange(300), "vec": x.tolist(), "neighbours": [[j for j in ((i + 1) % 150 + i // 150 * 150, (i + 150) % 300)] for i in range(300)]})
    found = vector_graph._search(table)
    assert any((a < 150) != (b < 150) for a, b in zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True))


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
    rows = [(1, mit), (2, "x\nReleased under the MIT License.\ny"), (3, "Licensed under CC BY-NC 4.0."), (4, "We licence nothing here."), (5, None), (6, "plain"), (7, "SPDX-License-Identifier: ISC")]
    got = {r.doc_id: (r.licenses, r.unmatched) for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    assert got == {1: ("MIT", 0), 2: ("MIT", 0), 3: ("CC-BY-NC", 0), 4: ("", 1), 5: ("", 0), 6: ("", 0), 7: ("ISC", 0)}
    assert licenses.scan_licenses(docs(spark, ODD)).count() == len(ODD) and licenses.scan_licenses(docs(spark, [])).count() == 0


MIT = """// Permission is hereby granted, free of charge, to any person obtaining a copy
// of this software and associated documentation files (the "Software"), to deal
// in the Software without restriction, including without limitation the rights
// to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
// copies of the Software, and to permit persons to whom the Software is
// furnished to do so, subject to the following conditions:
//
// The above copyright notice and this permission notice shall be included in all
// copies or substantial portions of the Software.
//
// THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
// IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
// FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
// AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
// LIABILITY."""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU {}General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""


def test_wrapped_licences_and_tags(spark):
    rows = [(1, MIT), (2, GPL.format("")), (3, GPL.format("Affero ")), (4, "# SPDX-License-Identifier: Apache-2.0 OR MIT\ncode"), (5, "code\r\nSPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0\r\n"), (6, "A long line of prose that goes on without any stop\nReleased under the MIT License\nand more of that prose in a line that goes on")]
    got = {r.doc_id: (r.licenses, r.unmatched) for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    assert got == {1: ("MIT", 0), 2: ("GPL-3.0", 0), 3: ("AGPL-3.0", 0), 4: ("Apache-2.0 OR MIT", 0), 5: ("GPL-2.0-only WITH Classpath-exception-2.0", 0), 6: ("MIT", 0)}


def test_more_licences(spark):
    said = {
        'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.': "MPL-2.0",
        "Released under the ISC License.": "ISC", "Licensed under the Artistic License 2.0": "Artistic", "Dual licensed under the MIT and GPL licenses.": "GPL,MIT", "Licensed under the MIT or Apache License, Version 2.0": "Apache-2.0,MIT",
        "Distributed under the University of Illinois/NCSA Open Source License.": "NCSA", "Licensed under the WTFPL": "WTFPL", "Licensed under 0BSD": "0BSD", "This is not licensed under the MIT license": "",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND.": "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appears.": "ISC",
        "It is no longer released under the GPL v2, but licensed under the MIT License": "",
    }
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(docs(spark, list(enumerate(said)))).collect()}
    assert got == dict(enumerate(said.values()))


def test_licences_named_without_an_anchor(spark):
    said = {
        "Released under the GPL v3": "gpl3Ref", "Distributed under the LGPL": "lgplRef", "Available under GNU GPL version 2.": "gpl2Ref", "Covered under AGPL v3": "agpl3Ref",
        "Released under CC0": "cc0", "Dedicated to zero": "cc0", "In no event shall the author be liable": "noLiability",
        "Neither the name of X may be used to endorse or promote products": "bsdNoEndorse", "See licensing": "mention",
    }
    rows = [(i, s) for i, s in enumerate(said)] + [(100, "\n".join(["All rights reserved", *said]))]
    got = {r.doc_id: r.sentences for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    assert got == dict(enumerate(said.values())) | {100: ",".join(["allRights", *said.values()])}


def lags(rows, shares):
    """The greatest distance of each source's blocks from its share of the slots so far, as long as all sources last."""
    last = min(max(r.slot for r in rows if r.source == s) for s in shares)
    done, worst = Counter(), 0.0
    at = {r.slot: r.source for r in rows}
    for t in range(last):
        done[at.get(t)] += 1
        worst = max(worst, *(abs(done[s] - w * (t + 1)) for s, w in shares.items()))
    return worst


def near_equal(n, low, high, last):
    return {f"s{i:02}": low if i == 0 else last if i == n - 1 else high[i % 2] for i in range(n)}


MIXES = [
    ({"a": 0.9999, "b": 0.0001}, 25_000), ({"a": 3.0, "b": 0.001, "c": 1.0}, 25_000), ({c: float(i + 1) ** 1.7 for i, c in enumerate("abcdefghijk")}, 25_000),
    (near_equal(20, 25.45, (25.9, 25.1), 27.55), 4_000), ({f"s{i:02}": 1 + 0.02 * math.sin(i) for i in range(40)}, 4_000),
]


@pytest.mark.parametrize("weights,slots", MIXES)
def test_schedule_stays_within_a_block_of_the_weights(spark, weights, slots):
    shares = {s: w / sum(weights.values()) for s, w in weights.items()}
    rows = spark.createDataFrame([(s, w, int(slots * shares[s]) + 1) for s, w in weights.items()], "source string, weight double, blocks long")
    got = mixing.schedule(rows).collect()
    assert len({r.slot for r in got}) == len(got) == len({(r.source, r.block) for r in got}) == sum(int(slots * w) + 1 for w in shares.values())
    assert all(r.released <= r.slot < r.due for r in got) and lags(got, shares) < 1


def test_schedules_of_random_mixes(spark):
    """Short rounds, so that many ends of rounds have to be joined."""
    draw = random.Random(9)
    for k in range(12):
        n = draw.choice([2, 3, 8, 20, 40])
        of = [lambda: draw.random() + 0.05, lambda: draw.random() ** 3 + 0.02, lambda: 1 + 0.05 * draw.random(), lambda: 2.0 ** -draw.randrange(6)][k % 4]
        weights = {f"s{i:02}": of() for i in range(n)}
        shares = {s: w / sum(weights.values()) for s, w in weights.items()}
        rows = spark.createDataFrame([(s, w, int(700 * shares[s]) + 1) for s, w in weights.items()], "source string, weight double, blocks long")
        got = mixing.schedule(rows, slots=16).collect()
        assert sorted((r.source, r.block) for r in got) == sorted((s, b) for s, w in shares.items() for b in range(int(700 * w) + 1))
        assert len({r.slot for r in got}) == len(got) and all(r.released <= r.slot < r.due for r in got) and lags(got, shares) < 1 + 1e-9, weights  # shares are rounded to grains
        for r in got:
            assert r.block / shares[r.source] - 1 - 1e-6 <= r.slot <= (r.block + 1) / shares[r.source] + 1e-6


def test_mixing_places_every_row(spark):
    rows = [(i, "t", "en", "a" if i % 3 else "b") for i in range(900)] + [(5000 + i, "t", "en", f"c{i % 7}") for i in range(350)] + [(None, "t", "en", None), (5000, "t", "en", "c0")]
    table = docs(spark, rows).selectExpr("*", "1 as slot", "2 as period", "3 as released", "4 as due", "5 as mix_part", "6 as doc", "7 as source_", "8 as block", "9 as mix_quota", "10 as rank")
    got = mixing.mix(table, block_rows=5, slots=64).collect()
    assert len(got) == len(rows) and {(r.slot, r.period, r.released, r.due, r.mix_part, r.doc, r.block) for r in got} == {(1, 2, 3, 4, 5, 6, 8)}
    blocks = {(r.mix_source, r.mix_block): r.mix_slot for r in got}
    assert len(set(blocks.values())) == len(blocks)
    assert all(0 <= r.mix_position < 5 for r in got) and max(Counter((r.mix_source, r.mix_block) for r in got).values()) == 5
    named = mixing.mix(table, spark.createDataFrame([("a", 2.0), ("b", None), (None, -1.0)], "source string, weight double"), block_rows=5).collect()
    assert len(named) == len(rows)
    assert mixing.mix(docs(spark, [])).count() == 0
    many = spark.range(800).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("source"))
    assert mixing.mix(many).select("mix_slot").distinct().count() == 800


def test_pipeline_stages(spark, table):
    kept = table
    names = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        names.append(name)
        new = stage(spark, kept, SF)
        assert new.columns == table.columns
        assert {r.doc_id for r in new.select("doc_id").collect()} <= {r.doc_id for r in kept.select("doc_id").collect()}
        kept = new
    got = {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()}
    assert got == {r.doc_id for r in kept.select("doc_id").collect()}
    assert len({re.sub(r"\s", "", r.text) for r in kept.collect()}) == kept.count()
    assert corpus_pipeline.STAGES[0][1](spark, docs(spark, [(1, None), (2, "12")]).select(table.columns), SF).count() == 0


def test_pipeline_like_brute_force(spark, table):
    """What language ID keeps, then equal texts, all pairs of texts and every token counted plainly."""
    kept = corpus_pipeline.STAGES[0][1](spark, table, SF).collect()
    groups = defaultdict(list)
    for r in kept:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append(r)
    kept = sorted((min(own, key=lambda r: (-len(r.text or ""), r.doc_id)) for own in groups.values()), key=lambda r: r.doc_id)
    read = []
    for r in kept:
        hashed = order_minhash.words(r.text or "")
        read.append((hashed, np.sort(order_minhash.labelled(order_minhash.shingles(hashed)))))
    root = list(range(len(kept)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(read):
        for j in range(i):
            if order_minhash.near(a, read[j][0], x, read[j][1]):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    kept = [r for i, r in enumerate(kept) if find(i) == i]
    encoder = WordIds(packing.default_tokenizer()).tokenizer
    want = {r.doc_id: len(encoder.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in kept}
    pieces, ends = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        assert r.doc_tokens == want[r.doc_id]
        pieces[r.doc_id].append((r.start, r.length))
        ends[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(want)
    for own, total in [*((pieces[i], want[i]) for i in want), *((own, sum(n for _, n in own)) for own in ends.values())]:
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at == total
    assert all(sum(n for _, n in own) <= packing.SEQUENCE for own in ends.values())


def test_word_ids_by_parts(monkeypatch):
    """Ids are the tokenizer's own, also of odd signs; plain words don't go through it, and the cache stays bounded."""
    from tracewright.llm import bpe_ids

    monkeypatch.setattr(bpe_ids, "MOST_WORDS", 50)
    monkeypatch.setattr(bpe_ids, "LATEST_WORDS", 50)
    words = WordIds(packing.default_tokenizer())
    signs = [*map(chr, range(0x20, 0x260)), *"̀̇ΣσK一 \U0001f600", "'s", "'LL", "''", "don't", "Été", " ", " ", " "]
    draw = random.Random(5)
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 25))) for _ in range(2_000)]
    for k in range(0, len(texts), 100):
        for text, ids in zip(texts[k : k + 100], words.of(texts[k : k + 100]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
    asked = []
    monkeypatch.setattr(words, "_encode", lambda texts: iter([asked.append(t) or b"" for t in texts]))
    list(words.of(["Strange wordings, l'été $$$ 12.5!"]))
    assert not asked
    list(words.of([]))
    assert len(words.words) <= 100
