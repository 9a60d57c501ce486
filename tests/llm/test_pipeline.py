"""The stages of the pipeline, each against brute force on its own input, with nulls, empty and repeated rows, and no rows."""

import collections
import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from platter.llm import decontam, mixing, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string"


def rows():
    r = random.Random(11)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [prose(30), prose(14)]
    texts = [prose(r.randrange(12, 200)) for _ in range(60)]
    for t in texts[:12]:
        w = t.split()
        w[r.randrange(len(w))] = word()
        texts += [t, " ".join(w)]
    texts += [prose(40) + " " + items[k % 2] + " " + prose(30) for k in range(6)]
    texts += ["one two", "", None, "# * $ | " * 30, "a b c d e " * 40, "line of some words\n" * 30, "\n".join(prose(20) for _ in range(9))]
    out = [(i, t, "en", "src%d" % (i % 4) if i % 9 else None, len(t or ""), "x") for i, t in enumerate(texts)]
    out += [out[20]] * 2 + [(None, out[3][1], "de", "src1", 5, None), (None, None, None, None, None, None), (*out[21][:3], "other", *out[21][4:])]
    return out, items


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    all_, items = rows()
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(all_, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), all_, items


def bag(rs):
    return collections.Counter(tuple(r) for r in rs)


def by_rules(all_):
    def measured(t):
        t = t or ""
        w = WORD.findall(t)
        g = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {k + j for k in range(len(w) - 4) if g[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_alpha_words": sum(bool(re.search("[A-Za-z]", x)) for x in w), "n_echo_words": sum(a == b for a, b in zip(w, w[1:])), "n_repeat_words": len(cover), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines))}

    table = pd.DataFrame([measured(r[1]) for r in all_])  # noqa: F841 (DuckDB reads it)
    used = [r.failed for r in rules.RULES if r.name in set(rules.POLICIES["base"]) | set(rules.POLICIES["v2"])]
    bad = duckdb.sql(f"SELECT {' OR '.join(f'coalesce({x}, false)' for x in used)} AS bad FROM \"table\"").df()["bad"]
    return [r for r, b in zip(all_, bad, strict=True) if not b]


def by_links(all_):
    def shingles(t):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1))))

    sets, up = [shingles(r[1]) for r in all_], list(range(len(all_)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(all_)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    best = {}
    for i, r in enumerate(all_):
        if sets[i]:
            best[root(i)] = min(best.get(root(i), (True, 0)), (r[0] is None, r[0] or 0))
    return collections.Counter([x for _, x in best.values()]), [r for r, s in zip(all_, sets, strict=True) if not s]


def dirty(text, items):
    t = re.findall(r"[0-9a-z]+", (text or "").lower())
    return any(min(decontam.myers(p.split(), t), default=99) <= decontam.budget(len(p.split())) for p in items)


def test_stages(spark, made, tmp_path):
    folder, all_, items = made
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "ngram_jaccard", "decontaminate", "mix_sources", "hilbert_shards"]

    def ran(name, on):
        out = stages[name](spark, on, folder)
        assert name == "hilbert_shards" or out.columns == docs.columns
        out.write.parquet(path := f"{tmp_path}/{name}-{random.random()}")
        return spark.read.parquet(path)

    # on all rows, null and empty texts included
    good = ran("quality_rules", docs)
    assert bag(good.collect()) == bag(by_rules(all_)) and 60 < good.count() < len(all_)
    ids, wordless = by_links(all_)
    one = ran("ngram_jaccard", docs).collect()
    assert bag(r for r in one if not WORD.search(r.text or "")) == bag(wordless)
    assert collections.Counter(r.doc_id for r in one if WORD.search(r.text or "")) == ids
    assert not bag(one) - bag(all_)
    assert bag(one) == bag(ran("ngram_jaccard", docs.repartition(5)).collect())
    clean = ran("decontaminate", docs).collect()
    assert bag(clean) == bag(r for r in all_ if not dirty(r[1], items)) and len(clean) == len(all_) - 6
    # one after the other, each on what its predecessor kept
    left = [tuple(r) for r in good.collect()]
    two = ran("ngram_jaccard", good)
    ids, wordless = by_links(left)
    assert collections.Counter(r.doc_id for r in two.collect()) == ids and not wordless
    three = ran("decontaminate", two)
    kept = [tuple(r) for r in two.collect() if not dirty(r.text, items)]
    assert bag(three.collect()) == bag(kept)
    four = ran("mix_sources", three)
    words, taken = {r[0]: WORD.findall(r[1]) for r in kept}, collections.defaultdict(list)
    assert len(words) == len(kept)
    for r in four.collect():
        w = WORD.findall(r.text)
        assert any(words[r.doc_id][k : k + len(w)] == w for k in range(len(words[r.doc_id]) - len(w) + 1)) and r.n_chars == len(r.text)
        taken[r.doc_id] += w
    assert all(max(collections.Counter(w).values()) <= 2 * max(collections.Counter(words[i]).values()) and len(w) <= 2 * len(words[i]) for i, w in taken.items())
    source = {r[0]: r[3] for r in kept}
    sizes = collections.Counter()
    for i, w in words.items():
        sizes[source[i]] += len(w)
    for p in mixing.plan(list(sizes.items()), 20240607):
        got = sum(len(w) for i, w in taken.items() if source[i] == p["source"])
        assert abs(got - p["target"]) <= 1 + p["source_size"] / mixing.BLOCK_WORDS
    five = ran("hilbert_shards", four)
    assert five.columns == [*docs.columns, "shard_", "slot"]
    assert bag(five.select(docs.columns).collect()) == bag(four.collect())
    held = collections.defaultdict(list)
    for r in five.collect():
        held[r.shard_].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in held.values()) and max(map(len, held.values())) - min(map(len, held.values())) <= 1
    assert bag(corpus_pipeline.run(spark, folder).select(docs.columns).collect()) == bag(four.collect())


def test_no_rows(spark, made):
    none = spark.createDataFrame([], SCHEMA).withColumn("slot", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, made[0])
        assert out.count() == 0 and out.columns[: len(none.columns)] == none.columns, name
