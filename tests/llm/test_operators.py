"""The corpus operators on small tables: against brute force, and the edge cases that their docstrings define."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import decontamination, html_text, language_id, near_dedup, nearest, packing, quality, sharding, suffix_dedup, url_filters

SYLLABLES = "the of ing ent ra mo ta ku lin dor ves pa".split()
LONG = "".join(random.Random(5).choice("abcde fgh") for _ in range(60_000))


def words(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus(seed=1, n=60):
    """Documents with nulls, empties, repeats, near copies, shared passages and a long one."""
    rng = random.Random(seed)
    base, passage = [words(rng, rng.randrange(3, 120)) for _ in range(n)], words(rng, 70)
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100, None), (101, ""), (102, "   \n"), (103, base[0]), (104, base[0]), (104, base[0]), (105, base[1] + " one more word"), (106, passage + " x " + base[2]), (107, base[3] + " y " + passage), (108, LONG), (109, "ünïcode ÄÖ " * 40), (110, "a"), (None, base[5])]
    return out


def docs(spark, rows=None):
    """The corpus with extra columns whose names the operators use inside."""
    rows = corpus() if rows is None else rows
    return spark.createDataFrame([(i, t, "x", 7, 1.5) for i, t in rows], "doc_id long, text string, node string, row int, score double")


def empty(spark):
    return docs(spark).where("1 = 0")


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def test_packing(spark):
    got = packing.pack(docs(spark), capacity=64, with_ids=True).collect()
    enc = packing.encoder(packing.default_tokenizer())
    want = sorted((-1 if i is None else i, len(enc.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in corpus())
    total = defaultdict(int)
    places = defaultdict(list)
    for r in got:
        assert r["length"] == len(r["ids"]) <= 64 and r["start"] == r["piece"] * 64
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        total[-1 if r["doc_id"] is None else r["doc_id"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    expected = defaultdict(int)
    for i, n in want:
        expected[i] += n
    assert total == expected
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) <= -(-sum(total.values()) // 64) * 1.1 + 1
    assert packing.pack(empty(spark)).count() == 0


def test_packing_plan_places_all():
    rng = random.Random(2)
    for _ in range(20):
        counts = {rng.randrange(1, 101): rng.randrange(1, 50) for _ in range(rng.randrange(1, 60))}
        plan = packing.plan(counts, 100)
        used = defaultdict(int)
        for length, first, n, each, seq, place in plan.tolist():
            for s in range(seq, seq + n):
                assert place == used[s], "gapless"
                used[s] += each * length
        assert all(v <= 100 for v in used.values()) and (plan[:, 2] * plan[:, 3]).sum() == sum(counts.values())


def test_chunk_encoder_is_the_tokenizer():
    rng = random.Random(1)
    enc = packing.encoder(packing.default_tokenizer())
    rows = ["".join(rng.choice("abzAZ 'stdm,.!?09_-é“”İßΣςñ²½́\x1c\x85\xa0\n\t<|>ªſﬁ中文😀") for _ in range(rng.randrange(1, 60))) for _ in range(2000)] + ["a<|endoftext|>b", "it's they'll 'S", ""]
    few = packing.ChunkEncoder(packing.default_tokenizer(), size=7)  # forgets all the time
    for e, step in ((enc, 300), (few, 5)):
        for i in range(0, len(rows), step):
            raw = [t.encode() for t in rows[i : i + step]]
            got, at = e.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
            for k, t in enumerate(rows[i : i + step]):
                assert got[at[k] : at[k + 1]].tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize(("hot", "sampled", "listed"), [(1500, 32, 1000), (2, 32, 1000), (2, 1, 1000), (2, 1, 3)])
def test_suffix_dedup(spark, hot, sampled, listed, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SAMPLED", sampled)
    monkeypatch.setattr(suffix_dedup, "LISTED", listed)
    monkeypatch.setattr(suffix_dedup, "RANGE", 1500 if hot == 2 else 200_000)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 5000)
    rows = corpus()
    seen = defaultdict(int)
    for _, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - 199):
            seen[b[j : j + 200]] += 1
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 199):
            if seen[b[j : j + 200]] > 1:
                gone[j : j + 200] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        want.append((-1 if i is None else i, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
    clash = F.lit("x")
    out = suffix_dedup.remove_repeats(docs(spark).withColumns({"kept_text": clash, "n_bytes": clash, "list": clash, "spans": clash}), with_text=True)
    assert [c for c in ("node", "row", "score") if c not in out.columns] == []
    got = [(-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["kept_text"]) for r in out.collect()]
    assert sorted(got) == sorted(want) and sum(r[2] for r in got) > 1000
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(3)
    for _ in range(30):
        size = rng.integers(5, 60, rng.integers(2, 8))
        x, end = rng.integers(97, 99, size.sum()).astype(np.uint8), np.cumsum(size)
        ends = np.repeat(end, size)
        order, rank, word = suffix_dedup.suffix_order(x, ends, int(size.max()))
        tails = [x[i : ends[i]].tobytes() for i in range(len(x))]
        assert [tails[i] for i in order] == sorted(tails)
        got = suffix_dedup.common_prefixes(order, rank, word, ends, end - size, size, 1000)
        for i in range(len(x)):
            if rank[i]:
                a, b = tails[i], tails[order[rank[i] - 1]]
                k = next((j for j, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
                assert got[i] == k


def test_language_id(spark):
    rng = random.Random(4)
    make = lambda s: " ".join("".join(rng.choice(s) for _ in range(3)) for _ in range(30))
    rows = [(i, make(["ba", "bo", "bu"]), "b") for i in range(40)] + [(100 + i, make(["ki", "ke", "ka"]), "k") for i in range(40)] + [(300, None, "b"), (301, "12 !!", "b"), (302, "", "k"), (303, "Kika KEKI", None)]
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(t, language_id.train(t)).collect()}
    assert all(got[i][0] == lang for i, text, lang in rows if lang and i < 300)
    assert got[300] == got[301] == got[302] == ("und", 0.0) and got[303][0] == "k" and 0 <= got[303][1] <= 1
    none = language_id.train(t.where("1 = 0"))
    assert {r["lang_pred"] for r in language_id.predict(t, none).collect()} == {"und"}
    assert language_id.predict(t.where("1 = 0"), none).count() == 0


def test_code_lengths_are_those_of_the_trees(spark):
    """Against a plain walk over context counts."""
    text = "abracadabra abba"
    t = spark.createDataFrame([(1, text, "x")], "doc_id long, text string, lang string")
    model = language_id.train(t)
    padded = b"\n" * language_id.ORDER + text.encode()
    counts = defaultdict(lambda: defaultdict(int))
    for i in range(language_id.ORDER, len(padded)):
        for k in range(language_id.ORDER + 1):
            counts[padded[i - k : i]][padded[i]] += 1

    def bits(context, byte):
        own = counts.get(context)
        if own:
            total, kinds = sum(own.values()), len(own)
            if byte in own:
                return -np.log2(own[byte] / (total + kinds))
            escape = -np.log2(kinds / (total + kinds))
        else:
            escape = 0
        return escape + (bits(context[1:], byte) if context else 8)

    for asked in ("abracadabra", "zebra", "b"):
        p = b"\n" * language_id.ORDER + asked.encode()
        want = sum(bits(p[i - language_id.ORDER : i], p[i]) for i in range(language_id.ORDER, len(p)))
        data = np.frombuffer(asked.encode(), np.uint8)
        assert model.bits(data, np.array([0, len(data)]))[0, 0] == pytest.approx(want, rel=1e-4)


def brute_components(rows):
    sets, first = [], {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            first[r] = min(first.get(r, d), d)
    return [(d, len(sets[k]), d if not sets[k] else first.get(find(k))) for k, (d, _) in enumerate(rows)]


@pytest.mark.parametrize(("limit", "few"), [(1000, 4), (4, 4), (4, 0)])
def test_near_dedup(spark, limit, few, monkeypatch):
    monkeypatch.setattr(near_dedup, "LIMIT", limit)
    monkeypatch.setattr(near_dedup, "FEW", few)
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", max(2, limit // 2))
    monkeypatch.setattr(near_dedup, "WEIGHT", limit // 2)
    rng = random.Random(8)
    rows, w = corpus(), words(rng, 80).split()
    for k in range(14):  # a chain and a star of near copies
        copy = list(w)
        for _ in range(k % 4):
            copy[rng.randrange(len(copy))] = f"q{k}"
        rows.append((500 + k, " ".join(copy)))
    # links through documents without doc_id
    rows += [(None, " ".join(w[:-1] + ["end"])), (None, " ".join(["start", *w[1:]])), (None, words(rng, 60)), (None, "")]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs(spark, rows)).collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted(brute_components(rows), key=key)
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_near_dedup_without_words(spark):
    """Partitions in which no text has a word."""
    for texts in ([None], [""], [" \t\n"], [None, "", " "]):
        rows = [(i, t) for i, t in enumerate(texts)]
        got = near_dedup.near_duplicates(docs(spark, rows).coalesce(1)).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == [(i, 0, i, True) for i, _ in rows]
    twice = near_dedup.near_duplicates(docs(spark, [(None, "a b c d e f g"), (None, "a b c d e f g"), (3, None)]).repartition(3)).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1, r["kept"]) for r in twice) == [(-1, 3, -1, True), (-1, 3, -1, True), (3, 0, 3, True)]


def test_links_are_those_of_all_pairs():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.r_[base[: rng.integers(30, 60)], rng.integers(0, 2**63, rng.integers(0, 12), dtype=np.uint64)]) for _ in range(40)]
    sketch = near_dedup.sketches(sets).astype(np.uint8)
    alike = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))

    def groups(pairs):
        up = list(range(40))
        for a, b in pairs:
            up = [up[a] if x == up[b] else x for x in up]
        return [up.index(x) for x in up]

    for side in (np.zeros(40, int), np.repeat([1, 2], 20)):
        want = [(i, j) for i in range(40) for j in range(i + 1, 40) if alike(sets[i], sets[j]) and (side[i] == 0 or side[i] != side[j])]
        assert groups(near_dedup.links(np.arange(40), side, sets, sketch)) == groups(want)


def test_sketches_estimate():
    rng = np.random.default_rng(1)
    for n in (1, 3, 40, 2000):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.r_[a[: max(1, n * 6 // 7)], rng.integers(0, 2**63, n - max(1, n * 6 // 7), dtype=np.uint64)]
        s = near_dedup.sketches([np.unique(a), np.unique(b)])
        assert (s < np.uint64(2**64 - 1)).all(), "every coordinate fills"
        want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - want) < 0.2


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = near_dedup.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    mine, theirs = defaultdict(set), defaultdict(set)
    for r in got:
        mine[r["label"]].add(r["node"])
        theirs[find(r["node"])].add(r["node"])
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header class="top">Site name</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<script>var x = "<p>no</p>";</script><div class="ad">Buy now</div><main><h1>A &amp; B</h1><p>The   first
paragraph of the text that is in it.<p>Short.<div class="share-bar"><a>Share</a></div><p hidden>hidden</p><form><label>Mail</label></form></main>
<div id="comments"><p>I was here and it is the best of all that I have seen in my life so far, and that is what I think of it.</p></div><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    assert html_text.extract(PAGE) == "A & B\nThe first paragraph of the text that is in it.\nShort."
    plain = "<div>menu</div><p>" + "the cat and the dog were in the house with all of the other animals that have been there. " * 4 + "</p><p>Yes.</p><div><a>one</a> <a>two</a></div>"
    assert html_text.extract(plain).endswith("there.\nYes.") and "one" not in html_text.extract(plain)
    for odd in ("<", "<p", "a < b", "<!-- x", "<script>", "<a title='x", "&#0;&#x110000;", "<p>" * 5000, "<" * 3000):
        html_text.extract(odd)
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", ""), (1, "u", PAGE)], "page_id long, url string, html string")
    got = [(r["page_id"], r["n_chars"], len(r["text"])) for r in html_text.main_text(pages).collect()]
    assert len(got) == 4 and all(n == k for _, n, k in got) and html_text.main_text(pages.where("1 = 0")).count() == 0


def test_quality_of_conflicting_labels(spark):
    """An id with both labels teaches nothing, however the labels are partitioned."""
    rng = random.Random(8)
    rows = [(i, words(rng, 30) + (" good" if i % 2 else " bad")) for i in range(120)]
    t = spark.createDataFrame(rows, "doc_id long, text string")
    clear = [(i, i % 2) for i in range(80)]
    both = clear + [(i, label) for i in range(80, 120) for label in (0, 1)] + clear[:9]
    kind = "doc_id long, quality int"
    want = quality.predict(t, quality.train(t, spark.createDataFrame(clear, kind))).collect()
    for parts in (1, 5):
        assert quality.predict(t, quality.train(t, spark.createDataFrame(both, kind).repartition(parts))).collect() == want


def test_quality(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, 40)) for i in range(60)] + [(100 + i, " | ".join(words(rng, 20).split())) for i in range(60)] + [(300, None), (301, "")]
    t = docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, _ in rows if i < 300 and i % 3] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(t, labels)
    got = {r["doc_id"]: r["score"] for r in quality.predict(t, model).collect()}
    held = [i for i, _ in rows if i < 300 and not i % 3]
    assert np.mean([(got[i] >= 0.5) == (i < 100) for i in held]) > 0.9
    assert got[300] == got[301] and all(0 <= s <= 1 for s in got.values())
    assert set(quality.scored(t, model).columns) == {"rest", "score"}
    alone = quality.train(t, labels.where("1 = 0"))
    assert {r["score"] for r in quality.predict(t, alone).collect()} == {0.5}
    assert quality.predict(empty(spark), model).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(600, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(600 + i, vectors[7].tolist()) for i in range(30)] + [(700, None), (750, [0.0] * 16), (800, [float("nan")] * 16), (850, [None] * 16), (900, [1.0] * 3), (7, vectors[7].tolist())]
    t = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, list string")
    got = defaultdict(list)
    for r in nearest.search(t, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ok = [(i, np.array(v)) for i, v in rows[:630]]
    hits = total = 0
    for q in [i for i, _ in ok if i % 50 == 0]:
        a = dict(ok)[q]
        near = sorted(((-(a @ v) / np.sqrt((a @ a) * (v @ v)), i) for i, v in ok if i != q))[:5]
        total += 5
        hits += len({i for _, i in near} & {i for i, _ in got[q]})
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
    assert hits / total >= 0.9
    assert nearest.search(t.where("1 = 0"), F.col("vec_id") % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in nearest.search(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2]


def test_url_filters(spark):
    urls = ["http://A.Net/x", "https://m.example.net/en/1", "http://example.net/fr/", "http://example.com/de/a?b#c", "http://notexample.com/de/", "http://x.org/fr/1", "http://net", "net/", None, "", "http://a.b.net/?q=://z", "http://example.com/DE/", "x://example.net/en/", "http://a.net/x"]
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id long, url string, key string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(pages).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block") and got[1][2:] == ("example.net/en/", "allow") and got[2][2:] == ("net/", "block")
    assert got[3] == ("example.com", "/de/a", "example.com/de/", "block") and got[4][2:] == (None, "allow") and got[5][2:] == ("org/fr/", "allow")
    assert got[6] == ("net", "", None, "allow") and got[7] == got[8] == got[9] == ("", "", None, "allow") and got[11][2] is None and got[13] == got[0]
    assert url_filters.judge(pages.where("1 = 0")).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.range(0, 4000, 7).select(F.concat(F.lit("k"), "id").alias("key"))
    c = url_filters.build(listed, universe)
    got = {r["key"] for r in universe.where(c.holds(F.col("key"))).collect()}
    assert got == {f"k{i}" for i in range(0, 4000, 7)} and len(c.levels) > 1


def test_sharding(spark):
    rows = [(i, f"t{i % 11}") for i in range(4000)] + [(None, None), (5, "t5")]
    t = spark.createDataFrame([(i, x, 0) for i, x in rows], "doc_id long, text string, shard int")
    got = sharding.assign(t, sharding.tree([1.0] * 40)).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(40))
    assert next(r for r in got if r["doc_id"] is None)["size"] == 16 and next(r for r in got if r["doc_id"] == 5)["text_crc32"] == zlib.crc32(b"t5")
    heavy = defaultdict(int)
    for r in sharding.assign(t, sharding.tree([3.0] + [1.0] * 9 + [0.0])).collect():
        heavy[r["shard"]] += 1
    assert heavy[10] == 0 and 2 < heavy[0] / heavy[1] < 4.5
    assert sharding.assign(t.where("1 = 0"), sharding.tree([1.0] * 3)).count() == 0


def test_decontamination(spark, monkeypatch):
    rng = random.Random(9)
    items = [(i, words(rng, 25)) for i in range(6)] + [(20, "Only Four WORDS here"), (21, ""), (22, None), (None, "x y z"), (3, "other text")]
    rows = corpus() + [(200, "lead " + items[0][1].upper() + ". tail"), (201, "only, four; words HERE only four"), (202, " ".join(items[1][1].split()[:12]) + " " + " ".join(items[2][1].split()[5:18])), (203, " ".join(items[1][1].split()[:9]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontamination.contamination(docs(spark, rows), bench).collect())
    pattern, windows = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), defaultdict(set)
    for i, t in items:
        w = pattern.findall(low(t))
        k = min(10, len(w))
        for j in range(len(w) - k + 1 if k and i is not None else 0):
            windows[tuple(w[j : j + k])].add(i)
    want = []
    for i, t in rows:
        w, found = pattern.findall(low(t)), set()
        hit = [0] * len(w)
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if own := windows.get(tuple(w[j : j + k])):
                    found |= own
                    hit[j : j + k] = [1] * k
        want.append((-1 if i is None else i, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), sum(hit) > 0))
    assert got == sorted(want) and sum(r[5] for r in got) >= 3
    assert decontamination.contamination(empty(spark), bench).count() == 0
    assert decontamination.contamination(docs(spark), bench.where("1 = 0")).where("contaminated").count() == 0
    for name, value in (("BLOCK_BYTES", 3000), ("ASKED", 2)):  # several blocks, several rows for a term: the same
        monkeypatch.setattr(decontamination, name, value)
    again = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontamination.contamination(docs(spark, rows), bench).collect())
    assert again == got


def test_index_holds_all_tokens(spark):
    """Of all words of all documents, whatever is searched."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    n = sum(len(pattern.findall(low(t))) for _, t in corpus())
    indexed = decontamination.index(docs(spark))
    assert indexed.agg(F.sum("n")).first()[0] == n == indexed.where("term IS NULL").select(F.explode("n_words").alias("n")).agg(F.sum("n")).first()[0]


def test_proximity(spark):
    item = "alpha beta gamma delta"
    t = docs(spark, [(1, "alpha beta x gamma delta"), (2, "alpha beta gamma delta"), (3, "alpha x x x x beta gamma delta")])
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    near = decontamination.search(decontamination.index(t), items, slop=1)
    assert {r["doc_id"] for r in near.collect()} == {1, 2}
    assert {r["doc_id"] for r in decontamination.search(decontamination.index(t), items).collect()} == {2}
