"""Token counts, collocations and Merkle manifests: against the library, plain readings and SQL, with the edge cases of their docstrings."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import collocations, merkle, token_counts

SF = "/root/testdata/sf0.001"
WIDE = "doc_id long, text string, lang string, source string, n_chars long, unit long, bucket int, tree string, pos long, range long"


def table(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, n, 1, 2, "x", 3, 4) for i, t, lang, s, n in rows], WIDE)


def odd_rows(seed=3):
    rng = random.Random(seed)
    words = ["the", "New", "york", "New york", "a's", "b.", "c;d", "naïve", "über", "日本語", "x\ty", "\x01low", "e" * 300, "<|endoftext|>", "12 3456", "  ", "\n\n", "ok!?", " ", "\U0001f600", "՘"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", "\n", "\r\n", ""]) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    texts += [None, "", " ", "\n", "new york new york new york", "z" * 20_000, texts[0], texts[0]]
    rows = [(i, t, rng.choice(["en", "de", None, "und"]), rng.choice(["web", None]), rng.choice([None, len(t or "")])) for i, t in enumerate(texts)]
    return rows + [(None, "new york", None, None, None), (3, "again", "en", "web", 5), rows[4]] + [rows[2]] * 3


def test_token_counts(spark):
    from tokenizers import Tokenizer

    rows = odd_rows()
    library = Tokenizer.from_file(token_counts.default_tokenizer())
    tokens = [len(e.ids) for e in library.encode_batch([r[1] or "" for r in rows], add_special_tokens=False)]
    want = Counter((r[0], len((r[1] or "").encode()), n, n > 20) for r, n in zip(rows, tokens, strict=True))
    for size in (1 << 20, 300):  # one unit, and many of them and of buckets
        got = token_counts.token_counts(table(spark, rows).repartition(3), limit=20, unit_bytes=size, bucket_bytes=size)
        assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        assert Counter(map(tuple, got.collect())) == want
    assert token_counts.token_counts(table(spark, rows).where("1 = 0")).count() == 0


def test_pre_tokens_of_all_characters():
    """The pattern and the tokenizer's own splits agree on what isn't sent to the latter."""
    own = token_counts.PreTokens(token_counts.default_tokenizer())
    for low in range(0, 0x10000, 64):
        if not 0xD800 <= low < 0xE000:
            text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}-{chr(c)}{chr(c)}\n " for c in range(low, low + 64) if not token_counts.OTHER.search(chr(c)))
            assert own.find(text) == [text[a:z] for _, (a, z) in own.split.pre_tokenize_str(text)]


def test_token_counts_refuse_other_tokenizers(spark):
    import public_tokenizers

    with pytest.raises(ValueError):
        token_counts.token_counts(table(spark, odd_rows()), public_tokenizers.path("word_bpe_49k.json"))


def mined_plainly(rows, longest, least, top):
    """The contract, word by word."""
    import re

    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(words)
            for k in range(1, longest + 1):
                f["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {p[i : i + k] for p, a in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 50 * counts[p[i : i + k]]}
        found = []
        for p, a in candidates.items():
            if p not in inside:
                score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, r[2].decode(), -r[1], r[3], r[4], n[lang], -r[0]) for i, r in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_collocations(spark, longest):
    rng = random.Random(longest)
    words = ["a", "b", "b\x01", "New", "york", "city", "ä", "日", "end.", "x;y", "(q)"]
    rows = odd_rows() + [(1000 + i, " ".join(rng.choice(words[: rng.randrange(2, 11)]) for _ in range(rng.randrange(1, 80))), rng.choice(["en", "de lu", None, ""]), None, None) for i in range(60)]
    for shard, width in ((1 << 20, 1 << 20), (500, 700)):  # a single range, and many that cut everywhere
        got = collocations.mined(table(spark, rows).repartition(3), longest, 3, 25, shard_bytes=shard, range_bytes=width)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == mined_plainly(rows, longest, 3, 25)
    assert collocations.mined(table(spark, rows).where("1 = 0")).count() == 0


def test_collocations_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = collocations.mined(docs.repartition(2), shard_bytes=60_000, range_bytes=20_000)
    want = con.sql(collocations.SQL).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_transducers():
    """Equal states are one; cuts and unions lose nothing; weights follow the phrases."""
    rng = np.random.default_rng(1)
    words = sorted([b"a ", b"b ", b"b\x01 ", b"c "])
    paths = [(np.c_[np.zeros(500, np.int64), rng.integers(0, 4, (500, k))] if k else np.zeros((1, 1), np.int64), np.ones(500 if k else 1, np.int64)) for k in range(4)]
    trie = collocations.tree(words, paths)
    read = lambda t: {tuple(t.words[i] for i in p): int(c) for level in range(t.depth) for p, c in zip(t.paths(level).tolist(), t.count[level], strict=True) if c}
    want = Counter(tuple(words[i] for i in p) for own, _ in paths for p in own.tolist())
    assert read(trie) == want and read(collocations.unpack(collocations.packed(trie))) == want
    ones = collocations.Trie(trie.words, trie.parent, trie.label, [np.ones(len(x), np.int64) for x in trie.count])
    machine = collocations.Transducer(ones)
    assert machine.states[3] == 2 and machine.states[2] == 2  # all words follow all pairs, so pairs share one state
    keys = sorted((tuple(words[i] for i in p) for p in ([0, 1], [0, 1, 2], [0, 2, 2, 2], [0, 3, 0])), key=collocations.sort_key)
    keys.append((b"zz ", b"a "))
    parts = dict(collocations.cuts(trie, keys))
    for i, part in parts.items():
        assert {k for k in read(part)} == {k for k in want if sum(collocations.sort_key(c) <= collocations.sort_key(k) for c in keys) == i}
    assert read(collocations.union(list(parts.values()))) == want
    double = collocations.union([trie, trie])
    assert read(double) == {k: 2 * v for k, v in want.items()}


def test_collocations_ask_together(spark, monkeypatch):
    """Frequent phrases of many ranges ask and tell as a few; a shard has one piece for each range, whatever its slices. The result is the plain one."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words[: rng.randrange(2, 41)]) for _ in range(60)), rng.choice(["en", "de", None]), None, None) for i in range(120)]
    docs, tables, staged = table(spark, rows).repartition(2), {}, collocations.staged
    monkeypatch.setattr(collocations, "SAMPLED", 500)
    monkeypatch.setattr(collocations, "staged", lambda df, name: tables.setdefault(name, staged(df, name)))
    got = collocations.mined(docs, 3, 3, 500, shard_bytes=4_000, range_bytes=500)
    assert sorted(map(tuple, got.collect())) == mined_plainly(rows, 3, 3, 500)
    ranges = tables["phrases"].select("range").distinct().count()
    assert ranges > 20 and tables["phrase-parts"].where(f"origin <> {collocations.WEIGHTS}").count() < ranges
    tables.clear()
    for slices, most in ((300, 1), (1_000, 2_000)):
        got = collocations.mined(docs, 3, 3, 500, shard_bytes=4_000, range_bytes=500, slice_bytes=slices, frequent_bytes=most)
        assert sorted(map(tuple, got.collect())) == mined_plainly(rows, 3, 3, 500)
        tables.clear()


def test_slices_of_a_shard(spark):
    """A shard's slices are parts of its phrases, in order; together they have every phrase as often, with one piece for each range and cut first word."""
    rng = random.Random(3)
    docs = pa.record_batch({"lang": ["en", "de"] * 20, "text": [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(50)) for _ in range(40)]})
    read = lambda tries: sum((Counter({tuple(t.words[i] for i in p): int(c) for level in range(t.depth) for p, c in zip(t.paths(level).tolist(), t.count[level], strict=True) if c}) for t in tries), Counter())
    whole = list(collocations.shards(iter([docs]), 3, 1 << 20))
    slices = list(collocations.shards(iter([docs]), 3, 1 << 20, 500))
    assert len(whole) == 1 and len(slices) > 3 and read(whole) == read(slices)
    keys = sorted(list(read(whole))[::9], key=collocations.sort_key)
    pieces = [i for t in slices for i, _ in collocations.cuts(t, keys)]
    assert len(pieces) <= len(keys) + 1 + 3 * len(slices) * (1 + len(keys) // 16)
    assert read([p for t in slices for _, p in collocations.cuts(t, keys)]) == read(whole)


def plainly_hashed(rows):
    """(doc_id, leaf, subroot, root, siblings) for each row, by whole levels."""
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def rise(nodes):
        """The top, and each node's siblings up to it."""
        beside, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, place in enumerate(at):
                if place ^ 1 < len(nodes):
                    beside[i].append(nodes[place ^ 1])
            nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
            at = [place // 2 for place in at]
        return nodes[0], beside

    groups = defaultdict(list)
    for i, text, lang, source, n in rows:
        groups[lang].append((i is not None, i or 0, h(*map(field, (i, source, lang, n, text))), i))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    tops = {lang: rise([r[2] for r in sorted(groups[lang], key=lambda r: r[:3])]) for lang in langs}
    root, over = rise([tops[lang][0] for lang in langs])
    return Counter((r[3], r[2], tops[lang][0], root, h(*own, *above)) for lang, above in zip(langs, over, strict=True) for r, own in zip(sorted(groups[lang], key=lambda r: r[:3]), tops[lang][1], strict=True))


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_merkle(spark, bits):
    rows = odd_rows() + [(2000 + i, f"t{i}", f"lang{i}", None, i) for i in range(5)]  # lone leaves, too
    docs = table(spark, rows).repartition(4)
    got = merkle.manifest(merkle.document_leaves(docs), ["doc_id"], bits, with_proofs=True).collect()
    assert Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in got) == plainly_hashed(rows)
    tampered = {r["doc_id"] for r in docs.where("crc32(cast(cast(doc_id as string) as binary)) % 7 = 0 AND n_chars IS NOT NULL").collect()}
    for r in got:
        assert merkle.folded(r["leaf"], merkle.decoded(r["proof"])) == r["root"]
        assert r["verified"] == (r["folded_root"] == r["root"])
    by_id = Counter(i for i, *_ in rows)
    assert {r["doc_id"] for r in got if not r["verified"] and by_id[r["doc_id"]] == 1} == {i for i in tampered if by_id[i] == 1} and tampered


def test_merkle_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = merkle.manifest(merkle.document_leaves(docs), ["doc_id"], 3)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(merkle.SQL).fetchall())
    assert merkle.manifest(merkle.document_leaves(docs.where("1 = 0")), ["doc_id"]).count() == 0
    one = merkle.manifest(merkle.document_leaves(docs.limit(1)), ["doc_id"]).select(F.col("leaf") == F.col("root")).first()
    assert one[0]


def test_compose_with_many_words():
    """Products of nodes and words pass 32 bits, though tries that were packed have 32-bit numbers."""
    n = 60_000
    words = [f"w{i:06d} ".encode() for i in range(n)]
    lang, first = np.zeros((n, 1), np.int64), np.arange(n)[:, None]
    paths = [(lang[:1], np.ones(1, np.int64)), (np.c_[lang, first], np.arange(1, n + 1)), (np.c_[lang, first, first[::-1]], np.arange(2, n + 2))]
    trie = collocations.unpack(collocations.packed(collocations.tree(words, paths)))
    found = collocations.compose(trie, trie)
    assert all((node == np.arange(len(node))).all() for node in found)
    assert (collocations.counted(trie, trie, np.c_[lang, first, first[::-1]]) == np.arange(2, n + 2)).all()


def test_ranges_follow_from_the_sample(spark):
    """As many ranges as the text asks for, however many partitions sort the sample."""
    rng = random.Random(7)
    docs = spark.createDataFrame([("en", " ".join(f"w{rng.randrange(3000)}" for _ in range(400))) for _ in range(300)], "lang string, text string").repartition(4)
    total = docs.selectExpr("sum(octet_length(text)) AS n").first()["n"]
    was, again = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for parts in ("1", "60"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            keys = collocations.range_keys(docs, total, 3, total // 10)
            assert 6 <= len(keys) <= 14 and keys == sorted(keys, key=collocations.sort_key)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", again)
