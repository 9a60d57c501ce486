"""Operators on documents against brute force, with nulls, empty and repeated rows, ties, clashing columns and empty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from platter.llm import decontam, hilbert, mixing, ngram_join, pfp, repair, rollup, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8)))
    base = [" ".join(word() for _ in range(n)) for n in (3, 30, 200, 600, 1500)]
    rows = [(i, t, "src%d" % (i % 3), "en") for i, t in enumerate(base)]
    for k, t in enumerate(base[1:4] * 6):  # near copies
        w = t.split()
        for _ in range(k % 4):
            w[r.randrange(len(w))] = word()
        rows.append((100 + k, " ".join(w), "src0", "en"))
    passage = " ".join(word() for _ in range(90))
    rows += [(200 + k, " ".join(word() for _ in range(40)) + "\n" + passage + "\n" + " ".join(word() for _ in range(40)), "src1", "de") for k in range(30)]
    rows += [(300, None, None, None), (301, "", "src1", "de"), (302, " \n\t", None, "de"), (303, "Straße Ünï ### | <x>\n\nÜnï", "src2", "de"), (None, base[2], "src0", None), (None, None, None, None)]
    rows += [(400, base[3], "src0", "en")] * 3 + [(401, "one", "src1", "en"), (402, "One", "src1", "en"), (403, "a b c d e f g h i j " * 12, "src2", "fr"), (404, "x" * 5000, "src2", "fr"), (405, "ab" * 900, "src2", "fr")]
    return rows


SCHEMA = "doc_id long, text string, source string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    """With columns that have the operators' own names."""
    plain = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    return plain.withColumns({c: F.lit(c) for c in ("n_words", "failed", "node", "n", "shard", "row", "key", "size", "part", "h", "found")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(rows):
    return collections.Counter(tuple(r) for r in rows)


def test_rules(docs, none):
    def want(i, t):
        t = t or ""
        w = WORD.findall(t)
        g = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {k + j for k in range(len(w) - 4) if g[tuple(w[k : k + 5])] > 1 for j in range(5)}
        seen, again = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        return i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)

    got = rules.digest(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert key(got) == key(want(r[0], r[1]) for r in corpus())
    kept = rules.kept(docs)
    assert kept.columns == docs.columns
    assert kept.count() == rules.digest(docs).where("kept").count()
    assert rules.digest(none).count() == 0
    book = rules.ledger(docs)
    for r in rules.ablations(book, "v2").collect():
        assert r.n_docs == len(corpus()) and r.n_only <= r.n_failed


def test_near_duplicates(docs, none):
    def shingles(t):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1))))

    rows = corpus()
    sets, up, links = [shingles(r[1]) for r in rows], list(range(len(rows))), [0] * len(rows)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(r[0], least.get(root(i), r[0]))
    want = key((r[0], len(sets[i]), least.get(root(i)) if sets[i] else r[0], links[i]) for i, r in enumerate(rows))
    assert key(ngram_join.digest(docs).collect()) == want
    one = ngram_join.one_of_each(docs)
    assert one.columns == docs.columns
    groups = len({root(i) for i in range(len(rows)) if sets[i]}) + sum(not s for s in sets)
    assert one.count() == groups
    assert ngram_join.digest(none).count() == 0


def test_near_duplicates_of_a_large_group(spark, monkeypatch):
    """A group of hundreds of variants around one text, all tokens frequent."""
    r = random.Random(9)
    base = ["w%d" % r.randrange(10**6) for _ in range(150)]
    rows = []
    for i in range(400):
        w = base[:]
        for _ in range(r.randrange(6)):
            w[r.randrange(150)] = "v%d" % r.randrange(10**6)
        rows.append((i, " ".join(w)))
    sets = [frozenset(tuple(t.split()[k : k + 5]) for k in range(146)) for _, t in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
                links[i] += 1
                links[j] += 1
    monkeypatch.setattr(ngram_join, "SLOT_NODES", 60)  # so the group is cut into cells
    got = {r.doc_id: (r.component_id, r.n_links) for r in ngram_join.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == {i: (root(i), links[i]) for i in range(len(rows))}


def test_shared_tokens(monkeypatch):
    r = np.random.RandomState(2)
    sets = [np.unique(r.randint(0, 300, n).astype(np.uint64)) for n in (1, 3, 50, 200, 0, 120)]
    monkeypatch.setattr(ngram_join, "COLUMNS", 7)
    got = ngram_join.shared_tokens(sets[:2], sets[2:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets[:2]]


def test_near_duplicates_whose_centre_is_too_small(spark):
    """Three sets share one token. The centre, the smallest, can link to nobody there; the other two are near and meet only there."""
    r = random.Random(3)
    word = lambda: "w%d" % r.randrange(10**6)

    def tokens(t):
        raw = np.frombuffer(t.encode(), np.uint8)
        return next(ngram_join.shingles(raw, np.array([0, len(raw)])))

    while True:  # until the private tokens of both come first, and the common one second, in the order of tokens
        w = [word() for _ in range(13)]
        b, c = " ".join([*w, word()]), " ".join([*w, word()])
        tb, tc = tokens(b), tokens(c)
        if tb[1] != tc[1] or tb[0] == tc[0]:
            continue
        at = next(i for i in range(9) if tokens(" ".join(w[i : i + 5]))[0] == tb[1] or i == 8)
        a = " ".join([*(word() for _ in range(4)), *w[at : at + 5], *(word() for _ in range(3))])
        ta = tokens(a)
        if ta[1] == tb[1] and ngram_join.identity(ta) < min(map(ngram_join.identity, (tb, tc))):
            break
    assert (len(ta), len(tb), len(tc), len(np.intersect1d(tb, tc))) == (8, 10, 10, 9)
    rows = spark.createDataFrame([(1, a), (2, b), (3, c)], "doc_id long, text string")
    assert sorted(tuple(x) for x in ngram_join.digest(rows).collect()) == [(1, 8, 1, 0), (2, 10, 2, 1), (3, 10, 2, 1)]


def test_repeated_passages(docs, none):
    rows = [(r[0], (r[1] or "").encode()) for r in corpus()]
    n = pfp.LENGTH
    count = collections.Counter(b[k : k + n] for _, b in rows for k in range(len(b) - n + 1))
    want = collections.Counter()
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if count[b[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[i, len(b), sum(gone), sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()] += 1
    assert key(pfp.digest(docs).drop("n_passages").collect()) == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in pfp.removed(docs).collect())
    assert pfp.digest(none).count() == 0


def test_passages_of_words(spark):
    """Passages of 51 words in several documents are reported, however few bytes they have and whatever stands between words; 50
    words, and what only one document has twice, are not."""
    r = random.Random(17)
    words = lambda n, k=3: [("%0" + str(k) + "d") % r.randrange(10**k) for _ in range(n)]
    long, short, own = words(51), words(50), words(60)
    rows = [(i, " ".join([*words(r.randrange(90), 6), *long, *words(r.randrange(90), 6)])) for i in range(40)]
    rows += [(100 + i, " ".join([*words(30, 6), *short, *words(30, 6)])) for i in range(20)]
    rows += [(200, " ".join([*own, *words(9, 6), *own])), (201, "\n".join(long)), (202, " ".join(long[:50])), (203, " ".join([*long, *words(70, 6), *long])), (204, " ".join(words(400, 6))), (205, None), (206, "")]
    rows += [(300, " ".join(w := words(70, 6))), (301, " ".join(w)), (302, " ".join([*w[:55], *words(3, 6), *w[4:60]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    count = collections.defaultdict(set)
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - pfp.PASSAGE + 1):
            count[tuple(w[k : k + pfp.PASSAGE])].add(i)
    want = {i: any(len(count[tuple(w[k : k + pfp.PASSAGE])]) > 1 for k in range(len(w) - pfp.PASSAGE + 1)) for i, t in rows for w in [(t or "").split()]}
    for n in (1, 7):
        got = {x.doc_id: x.n_passages for x in pfp.digest(df.repartition(n)).collect()}
        assert {i: x > 0 for i, x in got.items()} == want
        assert got[0] == got[201] == got[203] == got[300] == 1 and got[200] == got[100] == 0


def test_token_files(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(VOCABULARY))
    rows = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0))
    got = repair.digest(docs, str(VOCABULARY)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    ids = {t: tokenizer.encode(t or "", add_special_tokens=False).ids + [repair.END_ID] for t in {r[1] for r in rows}}
    raw = lambda t: b"".join(x.to_bytes(4, "little") for x in ids[t])
    assert key((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == key((r[0], len(ids[r[1]]), zlib.crc32(raw(r[1]))) for r in rows)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert repair.digest(none, str(VOCABULARY)).count() == 0


def test_token_file_round_trip():
    import numpy as np

    r = np.random.RandomState(1)
    ids = np.concatenate([r.randint(0, 40, 50_000), np.tile(r.randint(0, 9, 700), 60), np.full(3000, 7)]).astype(np.uint32)
    raw = repair.pack(np.arange(2), np.zeros(2, bool), np.array([50_000, len(ids) - 50_000]), ids, 49_408)
    shard = repair.Shard(raw)
    assert (shard.ids() == ids).all() and (shard.document(1) == ids[50_000:]).all()
    assert len(raw) < 2 * len(ids)
    for lo, hi in ((0, 1), (12_345, 12_400), (49_990, 60_000), (len(ids) - 1, len(ids) + 5)):
        assert (shard.ids(lo, hi) == ids[lo:hi]).all()


def test_mix(docs, none):
    rows = mixing.digest(docs).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert key((r.doc_id, r.size) for r in rows) == key((r[0], size(r[1])) for r in corpus())
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    total = sum(r.size for r in rows)
    by = {}
    for r in rows:
        s = by.setdefault((r.source_size, r.target), [0])
        s[0] += r.taken
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-6
    for (n, target), (taken,) in by.items():
        assert target <= 2 * n + 1e-9 and abs(taken - target) <= 1 + n / mixing.BLOCK_WORDS
    assert key(rows) == key(mixing.digest(docs).collect())
    out = mixing.mixed_texts(docs)
    assert out.columns == docs.columns
    assert sum(size(r.text) for r in out.collect()) == sum(r.taken for r in rows)
    assert mixing.digest(none).count() == 0 and mixing.mixed_texts(none).count() == 0
    assert all((r.n_shards > 0) == (r.taken > 0) == (r.first_shard is not None) for r in rows)


def test_mix_lies_by_shard(spark):
    """Quotas, disjointness and the local order against what the plan says, with words that occur once."""
    n = iter(range(10**9))
    rows = [(i, " ".join("w%d" % next(n) for _ in range(3000)), "src%d" % (i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    documents, blocks = mixing.mix(df, n_shards=7)
    b = blocks.collect()
    planned = mixing.plan([(s, sum(len(t.split()) for _, t, x in rows if x == s)) for s in ("src0", "src1", "src2")], 20240607, 7)
    for s in planned:  # each block instance is in one shard, each shard has its quota
        own = [x for x in b if x.code == s["code"]]
        assert len({(x.block, x.copy) for x in own}) == len(own) == s["instances"] + (s["tail"] > 0)
        held = collections.Counter(x.shard for x in own)
        assert [held[k] for k in range(7)] == list(np.diff([0, *s["upto"]]))
    total = collections.Counter(x.shard for x in b)
    assert max(total.values()) - min(total.values()) <= 1
    pieces = mixing.shards(df).collect()
    where = collections.defaultdict(set)
    for p in mixing.shards(df.where("doc_id >= 0")).collect():
        where[p.doc_id].add(p.shard)
    got = {r.doc_id: (r.n_shards, r.first_shard, r.last_shard) for r in mixing.digest(df).collect()}
    assert all(got[i] == (len(x), min(x), max(x)) for i, x in where.items())
    by = collections.defaultdict(list)
    for p in pieces:
        by[p.shard].append(p.slot)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by.values())
    # the texts lie by shard, in the order of the shuffle, and no shard keeps the order of the source
    out = mixing.placed_texts(df)
    parts = out.select("mix_shard", "mix_slot", "doc_id", "text", F.spark_partition_id().alias("part")).collect()
    assert all(len({x.part for x in parts if x.mix_shard == k}) == 1 for k in {x.mix_shard for x in parts})
    at = collections.defaultdict(list)
    for x in parts:
        at[x.mix_shard].append(x.mix_slot)
    assert all(v == sorted(v) for v in at.values()) and len(at) > 20
    words = collections.Counter(w for x in parts for w in x.text.split())
    assert max(words.values()) <= 2 and sum(words.values()) == sum(r.taken for r in mixing.digest(df).collect())


def test_splitting_tree():
    import numpy as np

    blocks = np.array([1000, 37, 0, 5, 400])
    quotas = mixing.splitting_tree(blocks, 7, 3)
    assert (quotas.sum(1) == blocks).all() and np.ptp(quotas.sum(0)) <= 1
    n = np.full(1000, 1000)
    assert sorted(mixing.permuted(np.arange(1000), n, np.full(1000, 5, np.uint64))) == list(range(1000))


def test_hilbert(spark, docs, none):
    cells = spark.range(512).select((F.col("id") % 8).cast("int").alias("x"), F.expr("cast(id div 8 % 8 as int)").alias("y"), F.expr("cast(id div 64 as int)").alias("z"))
    line = cells.withColumn("h", hilbert.curve_index([F.col("x"), F.col("y"), F.col("z")], 3)).orderBy("h").collect()
    assert [r.h for r in line] == list(range(512))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) == 1 for a, b in zip(line, line[1:]))
    rows = hilbert.shard(docs).collect()
    assert key((r.doc_id, r["size"], r.text_crc32) for r in rows) == key((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in corpus())
    held = collections.defaultdict(list)
    for r in rows:
        held[r.shard].append((r.slot, r.curve))
    sizes = [len(held[k]) for k in range(40)]
    assert max(sizes) - min(sizes) <= 1 and set(held) <= set(range(40))
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in held.values())
    curve = [c for k in sorted(held) for _, c in sorted(held[k])]
    assert curve == sorted(curve)
    assert hilbert.shard(none).count() == 0


def test_decontamination(spark, docs, none):
    r = random.Random(2)
    items = [(i, " ".join("q%d" % r.randrange(500) for _ in range(n))) for i, n in enumerate((5, 12, 20, 40, 80))] + [(9, None), (10, "a b"), (None, "")]
    planted, want = [], set()
    for k in range(60):
        i, text = items[k % 5]
        w = text.split()
        edits = k // 5 % (decontam.budget(len(w)) + 3)
        for p in r.sample(range(1, len(w) - 1), min(edits, len(w) - 2)):
            w[p] = "zz%d" % p
        planted.append((1000 + k, "before it, " + " ".join(w).upper().replace("ZZ", "yy") + "; after"))
        pattern, t = text.lower().split(), re.findall(r"[0-9a-z]+", planted[-1][1].lower())
        if min(decontam.myers(pattern, t)) <= decontam.budget(len(pattern)):
            want.add((1000 + k, i))
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.matches(both, bench).collect()
    assert {(m.doc_id, m.item_id) for m in got} == want and len(want) > 30
    assert {m.doc_id for m in got}.isdisjoint({m.doc_id for m in decontam.clean(both, bench).collect()})
    assert decontam.clean(both, bench).count() == both.count() - len({d for d, _ in want})
    assert decontam.matches(none, bench).count() == 0 and decontam.matches(both, bench.limit(0)).count() == 0
    assert decontam.clean(docs, bench).columns == docs.columns


def test_myers():
    r = random.Random(1)
    for _ in range(300):
        p, t = ([r.randrange(4) for _ in range(r.randrange(1, 70))], [r.randrange(4) for _ in range(r.randrange(80))])
        col, want = list(range(len(p) + 1)), []
        for x in t:
            new = [0]
            for i in range(1, len(p) + 1):
                new.append(min(col[i] + 1, new[i - 1] + 1, col[i - 1] + (p[i - 1] != x)))
            col = new
            want.append(col[-1])
        assert decontam.myers(p, t) == want


def test_rollup(spark, docs, tmp_path):
    state = rollup.Rollup(spark, f"file://{tmp_path}/state")
    first = rollup.inserts(rollup.counted(docs, "words-1"))
    state.commit("one", first)
    before = key(state.totals().collect())
    state.commit("one", first)
    assert key(state.totals().collect()) == before
    # a driver that dies before it publishes has changed nothing
    publish, rollup.Rollup._publish = rollup.Rollup._publish, lambda *a: (_ for _ in ()).throw(KeyboardInterrupt)
    with pytest.raises(KeyboardInterrupt):
        state.commit("one", rollup.inserts(rollup.counted(docs.limit(3), "words-1")))
    rollup.Rollup._publish = publish
    assert key(state.totals().collect()) == before
    state.commit("two", rollup.deletes(rollup.counted(docs, "words-1")))
    assert state.totals().count() == 0
    names = rollup.Rollup(spark, f"file://{tmp_path}/names")
    assert names.totals().count() == 0
    few = rollup.inserts(rollup.counted(docs, "words-1"))
    for name in (" b0", "\u20b0", "a/b", "a%2fb"):
        names.commit(name, few)
    assert names.totals().agg(F.sum("n_docs")).first()[0] == 4 * docs.count()
    state.commit("three", rollup.inserts(rollup.counted(docs, "words-1")))
    state.commit("four", rollup.revisions(rollup.counted(docs, "words-1").withColumn("was", F.col("tokens")).withColumn("tokens", F.col("tokens") * 2)))
    want = collections.Counter()
    for _, t, s, lang in corpus():
        want[s, lang] += 2 * len(WORD.findall(t or ""))
    assert {(r.source, r.lang): r.n_tokens for r in state.totals().collect()} == dict(want)
