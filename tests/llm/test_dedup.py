"""Exact, near and line duplicates, WARC bundles and the pipeline, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.llm import exact, linedup, setsketch, warc


def texts(seed=1, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3 and out:
            out.append(rng.choice(out))
        elif kind < 0.6 and out:
            w = rng.choice(out).split(" ")
            for _ in range(rng.randint(1, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
        elif kind < 0.7 and out:
            out.append(rng.choice(out).replace(" ", "  \n", 3))
        else:
            out.append(" ".join(word() for _ in range(rng.randint(1, 300))))
    return out


ODD = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "One"), (1004, "one"), (1005, "日本 語"), (None, "one"), (None, None), (1006, "x" * 30000), (1006, "x" * 30000), (1007, "A B"), (1008, "a  b")]


@pytest.fixture(scope="module")
def rows():
    return [*enumerate(texts()), *ODD]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "k", "r") for i, t in rows], "doc_id long, text string, kept string, recipe string").repartition(5)


@pytest.mark.parametrize("ident", [exact.sha_id, lambda c: (F.crc32(c) % 3).cast("string").cast("binary")])
def test_exact(spark, rows, docs, ident):
    """Also with identifiers that collide all the time."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    want = []
    for body, members in groups.items():
        keep = min((x for x in members if x[0] is not None), key=lambda x: (-len(x[1]), x[0]), default=(None, ""))[0]
        want += [(i, keep, len(members), i == keep, hashlib.sha256(body.encode()).hexdigest()) for i, _ in members]
    got = [tuple(r) for r in exact.exact_groups(docs, ident=ident).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns
    left = {}
    for r in kept.collect():
        left.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), []).append(r.doc_id)
    # Exactly one row of each group, the one that is marked, also where ids repeat or are null.
    assert left == {body: [next((w[1] for w in want if w[4] == hashlib.sha256(body.encode()).hexdigest()))] for body in groups}
    assert exact.drop_copies(docs.limit(0)).columns == docs.columns
    assert exact.exact_groups(docs.limit(0)).count() == 0


def brute_near(rows, size, percent):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets.append((i, {tuple(w[n : n + size]) for n in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                parent[find(a)] = find(b)
    out = []
    for n, (i, s) in enumerate(sets):
        ids = [sets[m][0] for m in range(len(sets)) if find(m) == find(n) and sets[m][0] is not None]
        comp = min(ids, default=None) if s else i
        out.append((i, len(s), comp, i == comp))
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_near(spark, rows, docs, size):
    got = [tuple(r) for r in setsketch.near_groups(docs, size, 80).collect()]
    assert sorted(got, key=str) == sorted(brute_near(rows, size, 80), key=str)
    assert setsketch.near_groups(docs.limit(0), size).count() == 0
    kept = setsketch.drop_near_copies(docs, size)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    assert sum(not words(t) for t in texts) == sum(not words(t) for _, t in rows)  # empty sets all stay
    groups = {(c, s) for _, s, c, _ in got if s}
    assert sum(bool(words(t)) for t in texts) >= len({c for c, _ in groups})
    again = setsketch.drop_near_copies(kept, size)  # one row of a group stays, so nothing more goes
    assert again.count() == len(texts)


def test_near_chain_in_one_bucket(spark, monkeypatch):
    """Links between members that are unlike the bucket's first are found as well."""
    monkeypatch.setattr(setsketch, "WIDE", 4)
    base = [f"w{n}" for n in range(200)]
    rows = []
    for n in range(12):  # each shifts by a few words: neighbours are alike, the ends are not
        w = base.copy()
        w[: 6 * n] = [f"v{m}" for m in range(6 * n)]
        rows.append((n, " ".join(w)))
    order = [3, 7, 0, 11, 5, 1, 9, 2, 10, 4, 8, 6]
    rows = [(order[i], t) for i, t in rows]
    got = setsketch.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_near(rows, 2, 80))


def test_prefix_filter_loses_no_link(spark, monkeypatch):
    """Every linked pair of different components is found, in one part or many, and pairs within one component are not."""
    monkeypatch.setattr(setsketch, "PART", 5)
    rng = np.random.default_rng(0)
    base = rng.integers(0, 400, 300)
    sets = []
    for n in range(90):
        keep = base[rng.random(300) < rng.choice([0.3, 0.9, 0.95, 1.0])]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 3000, rng.integers(0, 40))])).astype(np.int64))
    component = [n % 7 if n % 3 else 0 for n in range(90)]
    rows = [(n, component[n], len(s), bytearray(s.tobytes())) for n, s in enumerate(sets)]
    for percent in (50, 80, 95):
        placed = setsketch.prefix_rows(spark.createDataFrame(rows, "rep long, component long, n long, data binary"), percent)
        got = {tuple(sorted(p)) for p in setsketch.prefix_pairs(placed, percent).collect()}
        want = {(a, b) for b in range(90) for a in range(b) if component[a] != component[b] and 100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b]))}
        assert want and want <= got and all(component[a] != component[b] for a, b in got)


def test_recall_on_planted_copies(spark):
    """Pairs just above the threshold, among many texts, are found."""
    rng, rows, pairs = random.Random(6), [], []
    for n in range(0, 1200, 2):
        w = [f"a{rng.random()}" for _ in range(200)]
        v = w[: 200 - rng.randint(1, 20)]
        rows += [(n, " ".join(w)), (n + 1, " ".join(v + [f"b{rng.random()}"]))]
        s, t = (({*zip(x.split(), x.split()[1:])}) for x in (rows[-1][1], rows[-2][1]))
        if 100 * len(s & t) >= 80 * len(s | t):
            pairs.append((n, n + 1))
    got = {r.doc_id: r.component_id for r in setsketch.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    assert len(pairs) > 400 and all(got[b] == a for a, b in pairs)
    assert sum(got[i] != i for i, _ in rows) == len(pairs)


def test_one_hub_of_many_copies(spark, monkeypatch):
    """Copies that are alike only to one document, which is not the first, end in one group, by as many rows as copies."""
    rng = random.Random(3)
    base = [f"w{n}" for n in range(300)]
    rows = [(50, " ".join(base))]
    for n in range(100):
        w = base.copy()
        for at in rng.sample(range(300), 14):
            w[at] = f"x{n}.{at}"
        rows.append((n + (n >= 50), " ".join(w)))
    seen = []
    real = setsketch.pivots
    monkeypatch.setattr(setsketch, "pivots", lambda *a: seen.append(real(*a)) or seen[-1])
    got = setsketch.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_near(rows, 2, 80))
    assert len({r.component_id for r in got}) == 1 and seen[0].count() <= 32 * 101


def test_sketch_merges_and_estimates():
    rng = np.random.default_rng(1)
    pool = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    for shared in (0.2, 0.5, 0.8, 0.95):
        k = int(2000 * 2 * shared / (1 + shared))
        a, b = pool[:2000], np.concatenate([pool[2000 - k : 2000], pool[2000 : 4000 - k]])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        sa, sb = setsketch.sketch(a), setsketch.sketch(b)
        assert abs(setsketch.estimate(sa, float(len(a)), sb[None], np.array([float(len(b))]))[0] - true) < 0.13
        assert (setsketch.merge(sa, sb) == setsketch.sketch(np.union1d(a, b))).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(n, n + 1) for n in range(300, 340)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {(r.node, r.component) for r in setsketch.components(spark.createDataFrame(edges, "hub long, rep long")).collect()}
    assert got == {(x, find(x)) for x in parent}


def test_a_large_bucket_meets_what_decides_on_it_in_few_rows(spark):
    """Members of a large bucket go in a bounded number of parts, and all are still there; buckets of one component drop out."""
    members = [(1, rep, 0) for rep in range(3000)] + [(2, rep, 0) for rep in range(0, 3000, 2)] + [(3, 7, 5), (3, 8, 5)]
    labels = [(rep, rep % 2) for rep in range(2999)]
    rows = setsketch.open_buckets(spark.createDataFrame(members, "bucket long, rep long, first long"), spark.createDataFrame(labels, "node long, component long"))
    assert rows.count() <= setsketch.CELLS + 2
    got = {tuple(r) for r in setsketch.each_member(rows).collect()}
    assert got == {(1, 2999, rep, rep % 2 if rep < 2999 else rep) for rep in range(1, 3000)} | {(3, 2, 7, 1), (3, 2, 8, 0)}


def brute_lines(rows, least):
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is None, rows[n][0] or 0))
    seen, gone = set(), {}
    for n in order:
        lines = (rows[n][1] or "").split("\n")
        gone[n] = np.zeros(len(lines), bool)
        for at in range(len(lines) - least + 1):
            w = tuple(lines[at : at + least])
            if w in seen:
                gone[n][at : at + least] = True
            seen.add(w)
    return [(i, len(gone[n]), int(gone[n].sum()), "\n".join(x for x, g in zip((t or "").split("\n"), gone[n]) if not g)) for n, (i, t) in enumerate(rows)]


@pytest.mark.parametrize("least", [2, 3])
def test_line_runs(spark, least):
    rng = random.Random(4)
    pool = [f"line {n}" for n in range(12)]
    rows = [(n, "\n".join(rng.choice(pool) if rng.random() < 0.7 else f"only {rng.random()}" for _ in range(rng.randint(1, 14)))) for n in range(30)]
    rows += [(100, "\n".join(pool * 8)), (101, "\n".join(pool * 8)), (102, None), (103, ""), (104, "a\na\na\na"), (None, "\n".join(pool)), (105, "z" * 5000)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, row string, at string").repartition(4)
    got = [(r.doc_id, r.n_lines, r.n_deleted, r.text) for r in linedup.drop_repeated_runs(df, least).collect()]
    assert sorted(got, key=str) == sorted(brute_lines(rows, least), key=str)


def test_line_runs_are_maximal(spark):
    rows = [(1, "a\nb\nc\nd\nx"), (2, "p\na\nb\nc\nd\nq"), (3, "b\nc")]
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in linedup.drop_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [(1, 4, 3)], 3: [(0, 2, 3)]}
    assert linedup.drop_repeated_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_rows_are_later_copies(spark):
    rows = [(1, "a\nb"), (1, "a\nb")]
    got = sorted((r.doc_id, r.n_deleted) for r in linedup.drop_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 0), (1, 2)]


def test_a_long_line_alone_is_a_run(spark):
    long, short = " ".join(f"w{n}" for n in range(50)), " ".join(f"w{n}" for n in range(49))
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd"), (3, long), (4, short), (5, short), (6, f"{long}\nb\nx"), (7, None), (None, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_deleted, r.text, [tuple(x) for x in r.runs]) for r in linedup.drop_repeated_runs(df).collect()}
    assert got == {1: (0, rows[0][1], []), 2: (1, "c\nd", [(1, 1, 5)]), 3: (1, "", [(0, 1, 5)]), 4: (0, short, []), 5: (0, short, []), 6: (2, "x", [(0, 2, 5)]), 7: (0, "", []), None: (1, "", [(0, 1, 5)])}
    assert {r.doc_id for r in linedup.drop_repeated_runs(df, words=None).collect() if r.n_deleted} == {6}


def test_common_prefixes(spark):
    rng = random.Random(9)
    docs = [[rng.choice("abc") for _ in range(rng.randint(1, 40))] for _ in range(6)]
    docs.append(docs[0] + docs[1])
    df = spark.createDataFrame([(n, "\n".join(d)) for n, d in enumerate(docs)], "doc_id long, text string")
    staged = linedup.numbered(df, "doc_id", "text")
    final, parted, levels = linedup.suffix_array(staged)
    ids = {r["row"]: r["doc_id"] for r in staged.select("row", "doc_id").collect()}
    array = [(ids[r["row"]], r["at"]) for r in sorted(final.collect(), key=lambda r: r["rank"])]
    assert sorted(r["rank"] for r in final.collect()) == list(range(len(array)))
    lcp = {r["place"]: r["lcp"] for r in linedup.common_prefixes(final, parted, levels).collect()}

    def common(x, y):
        a, b = docs[x[0]][x[1] :], docs[y[0]][y[1] :]
        return next((n for n, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))

    assert [lcp.get(n, 0) for n in range(1, len(array))] == [common(array[n - 1], array[n]) for n in range(1, len(array))]


PAGES = [(5, "http://a/", "<p>" + "x" * 200), (3, "http://b/", "<p>" + "x" * 200), (9, None, "<p>" + "x" * 200), (4, "u\r\nv", "short"), (2, "w", "short"), (7, "n", None), (8, "e", ""), (None, "q", "<p>" + "x" * 200), (3, "http://b/", "<p>" + "x" * 200), (10, "é", "é" * 50), (11, "é", "é" * 50), (12, "big", "y" * 900_000)]


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    got = sorted((tuple(r) for r in warc.archive(pages).collect()), key=str)
    want = []
    for i, _, html in PAGES:
        body = (html or "").encode()
        first = min((p[0] for p in PAGES if p[0] is not None and (p[2] or "").encode() == body), default=None) if len(body) >= 100 else None
        refers = first if first is not None and (i is None or first < i) else None
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "response" if refers is None else "revisit", refers))
    assert got == sorted(want, key=str)
    assert warc.archive(pages.limit(0)).count() == 0
    bundles = warc.write_bundles(warc.with_targets(pages))
    index = warc.index_of(bundles).collect()
    assert len(index) == len(PAGES)
    for r in warc.export(bundles, str(tmp_path)).collect():
        data = open(r["path"], "rb").read()
        assert len(data) == r["bytes"]
        import zstandard

        whole = b"".join(warc.frame(data, e) for e in warc.seek_table(data))
        assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == whole  # any reader skips the table
        for x in (x for x in index if x["bundle"] == r["bundle"]):
            plain = warc.frame(data, warc.seek_table(data)[x["frame"]])
            assert warc.read_record(plain, x["frame_offset"])[0]["WARC-Record-ID"] == x["record_id"]


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    from terrace.llm import langid, packing, pii
    from terrace.llm.queries import secret_key, vocabulary

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "near_dedup", "pii_surrogates", "packing"]
    odd = spark.createDataFrame([(10**6, "123 !!!", "en", "s", 7), (10**6 + 1, None, None, None, None)], docs.schema)
    first = stages["language_id"](spark, docs.unionByName(odd), sf_dir)
    assert first.columns == docs.columns
    ids = {r.doc_id for r in first.select("doc_id").collect()}
    assert ids == {r.doc_id for r in docs.select("doc_id").collect()}  # clean documents stay, those without letters go
    second = stages["exact_dedup"](spark, docs, sf_dir)
    bodies = [re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in second.collect()]
    assert len(set(bodies)) == len(bodies) and set(bodies) == {re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in docs.collect()}
    third = stages["near_dedup"](spark, second, sf_dir)
    near = brute_near([(r.doc_id, r.text) for r in second.collect()], 5, 80)
    assert {r.doc_id for r in third.collect()} == {i for i, _, _, kept in near if kept}
    fourth = stages["pii_surrogates"](spark, third, sf_dir)
    before, after = {r.doc_id: r.text for r in third.collect()}, {r.doc_id: r for r in fourth.collect()}
    assert fourth.columns == docs.columns and before.keys() == after.keys()
    for i, text in before.items():
        found = pii.detect(text)
        assert (after[i].text == text) == (not found) and after[i].n_chars == len(after[i].text)
        assert not any(text[a:b] in after[i].text for a, b, _, _ in found if b - a > 6)
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in whole} == set(before)


def test_pipeline_on_odd_tables(spark, sf_dir):
    """Empty tables, null and repeated ids, null texts and repeated rows."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    some = [r.text for r in docs.orderBy("doc_id").limit(3).collect()]
    rows = [(None, some[0], "en", "s", 1), (None, some[0], "en", "s", 1), (7, some[1], "en", "s", 1), (7, some[1], "en", "s", 1), (7, some[2], None, None, None), (8, None, None, None, None), (9, "", "en", "s", 0), (None, None, None, None, None)]
    odd = spark.createDataFrame(rows, docs.schema)
    for name, function in corpus_pipeline.STAGES:
        assert function(spark, docs.limit(0), sf_dir).count() == 0, name
        out = function(spark, odd, sf_dir)
        if name != "packing":
            assert out.columns == docs.columns
        left = sorted((r.doc_id for r in out.collect()), key=str)
        if name == "language_id":
            assert left == [7, 7, 7, None, None]
        elif name == "exact_dedup":
            assert left == sorted([7, 7, None, 8], key=str)  # of the three empty ones the least id stays
        elif name == "near_dedup":
            assert left == sorted([7, 7, None, 8, 9, None], key=str)  # empty sets are linked with nothing
        elif name == "pii_surrogates":
            assert left == sorted((r[0] for r in rows), key=str)


def test_word_count_of_lines(spark):
    rng = random.Random(4)
    lines = ["", " ", "  ", "a", " a", "a ", " a b ", "é  ü", "a\tb", "\x0b", "a\rb c", " x"] + ["".join(rng.choice("ab é\t\x0b\f\r  ") for _ in range(rng.randint(1, 30))) for _ in range(200)]
    got = spark.createDataFrame([(s,) for s in lines], "s string").select("s", linedup.word_count(F.col("s")).alias("n")).collect()
    assert all(r["n"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["s"])) for r in got)
