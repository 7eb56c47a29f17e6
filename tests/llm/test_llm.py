"""The corpus operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

import collections
import difflib
import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import bpe, html, linededup, lmscore, nndescent, packing, quality, sharding, simhash, textfeatures, toxicity
from tessella.llm.components import connected_components

ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (4, "a"), (None, "b c d e f"), (5, "x " * 20_000), (6, "\U0001f600 é " * 9), (7, "line one\nline one\nline two")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, repeats, a long text; an extra column with an operator's own name."""
    return spark.createDataFrame([(i, t, "fp") for i, t in ODD], "doc_id long, text string, fp string").repartition(3)


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijk", k=rng.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Clean texts, near copies, and toxic texts (with words of their own)."""
    rng = random.Random(3)
    rows = [(i, "\n".join(words(rng, 30) for _ in range(4))) for i in range(120)]
    for i in range(20):
        w = rows[i][1].split(" ")
        w[3] = "changed"
        rows.append((200 + i, " ".join(w)))
    for i in range(120):
        rows.append((300 + i, f"{words(rng, 40)} zzidiot {words(rng, 9)} zzscum zzidiot {words(rng, 20)}"))
    return rows


def test_toxicity(spark, corpus, odd):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i >= 300)) for i, _ in corpus] + [(None, 1, 1), (9999, 1, None)], "doc_id long, quality int, toxic int")
    m = toxicity.fit_toxicity(docs, labels)
    out = {r["doc_id"]: r for r in toxicity.toxicity(docs, m).collect()}
    assert all(r["predicted"] == (i >= 300) for i, r in out.items())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in out.items())
    count = toxicity.TermCounter(m.terms)
    dense = np.zeros((len(m.ids), len(m.terms)))
    for i, x in enumerate(m.ids):
        t, v = m.vector(count(dict(corpus)[x]))
        dense[i, t] = v
    for i in (301, 333, 5):
        t, v = m.vector(count(dict(corpus)[i]))
        q = np.zeros(len(m.terms))
        q[t] = v
        s = dense @ q
        want = np.sort(s[s > 0])[::-1][: toxicity.NEIGHBOURS]
        assert np.allclose(m.nearest(count(dict(corpus)[i]))[1], want)
    assert toxicity.toxicity(odd, m).count() == len(ODD) and toxicity.keep_civil(odd, m).columns == odd.columns
    assert toxicity.toxicity(odd.limit(0), toxicity.fit_toxicity(odd.limit(0), labels.limit(0))).count() == 0


def test_sharding(spark, odd):
    df = spark.range(10_007).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")).repartition(5)
    out = sharding.shard_documents(df, 24).collect()
    sizes = {}
    for r in out:
        sizes.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(r["doc_id"] for r in out) == list(range(10_007)) and max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    assert all(r["size"] == len(str(r["doc_id"])) + 8 and r["text_crc32"] == zlib.crc32(str(r["doc_id"]).encode()) for r in out)
    small = sharding.shuffle_to_shards(df, 3, columns=[F.col("doc_id")], block_rows=100).collect()
    assert sorted(r["slot"] for r in small if r["shard"] == 0) == list(range(3336))
    assert sharding.shard_documents(odd, 24).count() == len(ODD) and sharding.shard_documents(odd.limit(0)).count() == 0
    rng = random.Random(1)
    draws = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(20_000)]
    assert abs(np.mean(draws) - 6) < 0.05 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.15


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = nndescent.nearest(df, df.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("id"))).collect()
    got = {}
    for r in out:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    d = x.astype(float)
    for q in range(0, 3000, 20):
        s = d @ d[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(3000), -np.round(s, 9)))[:20]
        hit += len(set(want.tolist()) & {v for _, v, _ in got[q]})
        assert [k for k, _, _ in sorted(got[q])] == list(range(1, 21)) and all(abs(s[v] - c) < 1e-9 for _, v, c in got[q])
    assert hit / (150 * 20) >= 0.9
    assert nndescent.nearest(df.limit(0), df.select(F.col("vec_id").alias("id"))).count() == 0


def test_nearest_of_unequal_lengths(spark):
    """A table much larger than two runs, with lengths that differ by orders of magnitude: the nearest are long vectors far away."""
    rng = np.random.default_rng(17)
    x = rng.normal(size=(20_000, 24)) * np.exp(rng.normal(size=(20_000, 1)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = list(range(0, 20_000, 100))
    got = {}
    for r in nndescent.nearest(df, spark.createDataFrame([(i,) for i in asked], "id long")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q in asked:
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20].tolist()) & got[q])
    assert hit / (20 * len(asked)) >= 0.95, hit / (20 * len(asked))


@pytest.mark.parametrize("n", [2, 18, 60])
def test_nearest_of_few(spark, n):
    """Small tables are searched whole: every candidate is met."""
    x = np.random.default_rng(n).normal(size=(n, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = nndescent.nearest(df, df.select(F.col("vec_id").alias("id"))).collect()
    got = {q: [r["vec_id"] for r in sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])] for q in range(n)}
    for q in range(n):
        s = x @ x[q]
        s[q] = -np.inf
        assert got[q] == np.argsort(-s)[: min(20, n - 1)].tolist()


def test_nearest_beside_one_huge_vector(spark):
    x = np.random.default_rng(3).normal(size=(4000, 16))
    x[11] *= 1e6
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nndescent.nearest(df, df.filter("vec_id % 40 = 0").select(F.col("vec_id").alias("id"))).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q in range(0, 4000, 40):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20].tolist()) & got[q])
    assert hit / 2000 >= 0.95


def test_nearest_in_shares(spark, monkeypatch):
    """Vectors are exchanged in shares, with the results of one exchange; afterwards only the results are left on disk."""
    x = np.random.default_rng(5).normal(size=(900, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    kept, rounds = [], []
    stored, proposals = nndescent.stored, nndescent.proposals
    monkeypatch.setattr(nndescent, "stored", lambda d: kept.append(stored(d)) or kept[-1])
    monkeypatch.setattr(nndescent, "proposals", lambda *a: rounds.append(a[3:5]) or proposals(*a))
    monkeypatch.setattr(nndescent, "SHARE_BYTES", 2_100_000)  # of 900 x 64 vectors of 36 bytes and 32 more: 2 shares
    got = {}
    for r in nndescent.nearest(df, df.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("id"))).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert rounds[:2] == [(0, 2), (1, 2)] and len(rounds) % 2 == 0
    d = x.astype(float)
    hit = 0
    for q in range(0, 900, 100):
        s = d @ d[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20].tolist()) & set(got[q]))
    assert hit / 180 >= 0.95
    left = [k for k in kept if os.path.isdir(k._tessella_path)]
    assert 1 <= len(left) == sum(k.columns == ["query_id", "rank", "vec_id", "score"] for k in kept)


def test_search_goes_on_until_nothing_is_left(spark):
    """On a chain towards longer vectors, a search walks all the way, not a fixed number of hops."""
    half = nndescent.scaled_vectors(spark.createDataFrame([(i, [float(i + 1), 0.0]) for i in range(13)], "id long, x array<double>"), 0)
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)], "u long, v long")
    found = nndescent.search(edges, half, spark.createDataFrame([(0,)], "q long"), spark.createDataFrame([], "v long"), beam=64)
    assert {r["v"] for r in found.collect()} == set(range(13))


def test_language_model(spark, odd):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["the cat sat on", "a dog ran to", "some bird flew by"]) + " it" for _ in range(30))) for i in range(60)], "doc_id long, text string")
    net = lmscore.fit_network(docs)
    assert np.allclose(np.exp(net.table.reshape(-1, lmscore.CLASSES)[:500]).sum(axis=1), 1, atol=1e-4)
    out = lmscore.pseudo_likelihood(docs, net).collect()
    shuffled = lmscore.pseudo_likelihood(docs.select("doc_id", F.array_join(F.shuffle(F.split("text", " ")), " ").alias("text")), net).collect()
    assert np.mean([r["mean_log_likelihood"] for r in out]) > np.mean([r["mean_log_likelihood"] for r in shuffled]) + 1
    classify = lmscore.Classifier(net.frequent)
    text = docs.first()["text"]
    c = [0, *classify(text).tolist(), 0]
    want = sum(net.table[(c[i - 1] * lmscore.CLASSES + c[i + 1]) * lmscore.CLASSES + c[i]] for i in range(1, len(c) - 1))
    assert abs(next(r for r in out if r["doc_id"] == docs.first()["doc_id"])["log_likelihood"] - want) < 1e-2
    some = lmscore.pseudo_likelihood(odd, lmscore.fit_network(odd)).collect()
    assert len(some) == len(ODD) and all(r["mean_log_likelihood"] is None for r in some if r["n_words"] == 0)
    assert lmscore.pseudo_likelihood(odd.limit(0), net).count() == 0


def test_language_model_tells_rare_words_apart(spark):
    """Each word has a probability of its own: those of a class and of words never seen add up to one."""
    rng = random.Random(12)
    common = [f"w{i}".replace("0", "o") for i in range(lmscore.FREQUENT)]
    many, by_class = {}, {}
    for i in range(3000):
        w = "".join(rng.choices("abcdefgh", k=9))
        many[w] = 1 + i % 3
    texts = [" ".join(common * 40)] + [" ".join([w] * n) for w, n in many.items()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    net = lmscore.fit_network(docs)
    assert set(net.frequent) == set(common) and net.words.count() == len(many)
    for w in many:
        by_class.setdefault(lmscore.word_class(w), []).append(w)
    k, same = max(by_class.items(), key=lambda x: len(x[1]))
    asked = spark.createDataFrame([(i, w) for i, w in enumerate(same + same[:1])], "doc_id long, text string")
    got = {r["doc_id"]: r["log_likelihood"] for r in lmscore.pseudo_likelihood(asked, net).collect()}
    top = float(net.table[k])
    size = sum(many[w] + 1 for w in same) + 1
    assert all(abs(got[i] - top - np.log((many[w] + 1) / size)) < 1e-6 for i, w in enumerate(same)) and abs(got[len(same)] - got[0]) < 1e-12
    assert abs(sum(np.exp(got[i] - top) for i in range(len(same))) + 1 / size - 1) < 1e-6


@pytest.fixture(scope="module")
def trees():
    return html.train()


def test_html(spark, trees):
    rng = random.Random(99)
    right = total = 0
    for _ in range(60):
        page = html.training_page(rng)
        nodes = html.parse(page)
        truth = np.array([any(isinstance(p, str) and html.MARK in p for p in x.parts) for x in nodes])
        clean = html.parse(page.replace(html.MARK, ""))
        f, own = html.features(clean, trees.odds)
        keep = html.decode(clean, trees.trees.margin(f), own)
        assert all(keep[x.parent] for i, x in enumerate(clean) if keep[i] and i)
        right += (keep == truth)[own > 0].sum()
        total += (own > 0).sum()
    assert right / total > 0.93
    page = "<body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>One<br>two\n  three.</p><p>It &eacute; is a long enough text, with some words in it.</p></article><footer>&copy; me</footer></body>"
    assert html.extract([page, None, "", "<"], trees) == ["A & B One two three. It é is a long enough text, with some words in it.", "", "", html.extract(["<"], trees)[0]]
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (None, None, None)], "page_id long, url string, html string")
    assert html.main_text(df, trees).count() == 3 and html.main_text(df.limit(0), trees).count() == 0


def test_html_counts_same_tags_among_many(trees):
    """A single h1 among a hundred paragraphs has one sibling of its tag, itself, as among few."""
    column = 21
    for n in (10, 100):
        nodes = html.parse("<body><h1>Title</h1>" + "<p>text</p>" * n + "</body>")
        f, _ = html.features(nodes, trees.odds)
        assert [f[i, column] for i, x in enumerate(nodes) if x.tag == "h1"] == [1] and {f[i, column] for i, x in enumerate(nodes) if x.tag == "p"} == {n}


PROSE = "A long paragraph of ordinary words, with commas, full stops and enough length to be the main text of a page. " * 3
NAV = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"


@pytest.mark.parametrize("page", [
    "{nav}<article class='post author'><p>{p}</p></article>", "{nav}<article class='news-banner'><p>{p}</p><p>{p}</p></article>", "{nav}<div class='content meta'><p>{p}</p><p>{p}</p></div>",
    "<form action=/x method=post>{nav}<article><p>{p}</p></article></form>", "{nav}<article title=it's><p>{p}</p></article>", "<nav><a href=/x'y>z</a></nav><article><p>{p}</p></article>",
    "{nav}<div/><article><p>{p}</p></article>", "<nav><a href=/x/>z</a></nav><article><p>{p}</p></article>", "{nav}<article data-x=\"a > b\"><p>{p}</p></article>",
])
def test_html_names_that_mislead(trees, page):
    text = html.extract([f"<html><body>{page.format(nav=NAV, p=PROSE)}<footer>&copy; 2020 the makers</footer></body></html>"], trees)[0]
    assert text == " ".join([PROSE.strip()] * page.count("{p}")), text[:80]


def foreign_page(rng):
    """Pages of another kind than the training pages: other names, other nesting, real words; and their main text."""
    vocabulary = "the river was wide and slow when they reached its bank in early spring because rain had fallen over all hills for many days".split()
    line = lambda n: " ".join(rng.choices(vocabulary, k=n)).capitalize() + "."
    main = [line(rng.randint(25, 90)) for _ in range(rng.randint(2, 7))]
    title = line(6)
    body = f"<h2 class=hd>{title}</h2>" + "".join(f"<p class=t{i}>{x}</p>" for i, x in enumerate(main))
    holder = rng.choice(["<div class='zq-17'><div class='kk'>{}</div></div>", "<section id=n4><div>{}</div></section>", "<main class=xq><article>{}</article></main>", "<table><tr><td class=vv>{}</td></tr></table>"])
    menu = "<div class=mm><ul>" + "".join(f"<li><a href=/{i}>{line(2)}</a></li>" for i in range(rng.randint(4, 12))) + "</ul></div>"
    end = f"<footer><div>&copy; 2001 {line(3)}</div><a href=/t>{line(2)}</a></footer>"
    aside = f"<aside><h4>{line(2)}</h4><ul><li><a href=/q>{line(4)}</a></li><li><a href=/r>{line(4)}</a></li></ul></aside>"
    return f"<html><body><div id=outer>{menu}{holder.format(body)}{rng.choice(['', aside])}{end}</div></body></html>", " ".join([title, *main])


def test_html_of_another_generator(trees):
    rng = random.Random(77)
    right = found = wanted = 0
    for page, want in (foreign_page(rng) for _ in range(120)):
        got, want = html.extract([page], trees)[0].split(), want.split()
        both = sum(m.size for m in difflib.SequenceMatcher(None, got, want, autojunk=False).get_matching_blocks())
        right, found, wanted = right + both, found + len(got), wanted + len(want)
    assert right / wanted > 0.95 and right / found > 0.95, (right / wanted, right / found)


def roots_of(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots_of({n for e in edges for n in e}, edges)
    assert got == {n: r for n, r in want.items() if any(n in e for e in edges if e[0] != e[1])}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [simhash.BLOCK, 3])
def test_simhash_links(spark, block):
    rng = random.Random(6)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(12):
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6)))
            fps.add(x)
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    found = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, block).collect()
    want = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    assert roots_of(signed, [(r["a"], r["b"]) for r in found]) == roots_of(signed, want)


def test_simhash(spark, odd, corpus):
    import xxhash

    text = "Some Words of É x a text, a Text"
    w = text.encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(len(w) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.majority(simhash.shingle_hashes(text, 4)) == want
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == len(ODD) and {r["component_id"] for r in out if r["fingerprint"] == "0" * 16} == {1}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fp = {i: int(r["fingerprint"], 16) for i, r in got.items()}
    links = [(a, b) for a, b in itertools.combinations(sorted(fp), 2) if (fp[a] ^ fp[b]).bit_count() <= 4]
    assert {i: r["component_id"] for i, r in got.items()} == roots_of(set(fp), links)


def test_near_duplicates_leave_one_row_of_each_group(spark, odd):
    rng = random.Random(14)
    a, b, c = (words(rng, 80) for _ in range(3))
    rows = [(7, a, "first"), (3, a, "copy"), (3, b, "same id, another text"), (3, a, "copy"), (None, c, "no id"), (None, c, "no id"), (9, None, "null"), (8, "", "empty"), (8, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("root", F.lit(1)).repartition(3)
    out = simhash.keep_one_of_each(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"], r["fp"]) for r in out.collect()) == sorted([(3, a, "copy"), (3, b, "same id, another text"), (0, c, "no id"), (8, "", "empty")])
    assert simhash.keep_one_of_each(odd.limit(0)).columns == odd.columns


def test_packing(spark, odd):
    rng = random.Random(7)
    sizes = [rng.randint(1, 4096) for _ in range(500)]
    where, at, capacity = packing.pack(sizes)
    inside = {}
    for size, b, a, c in zip(sizes, where, at, capacity, strict=True):
        inside.setdefault((b, c), []).append((a, size))
    for (_, c), items in inside.items():
        items.sort()
        assert all(a == sum(s for _, s in items[:i]) for i, (a, _) in enumerate(items))
        used = sum(s for _, s in items)
        assert used <= c and c == min(n for n in packing.LENGTHS if n >= used)
    assert sum(sizes) / sum(c for _, c in inside) > 0.93 and packing.pack([]) == ([], [], [])
    packed = packing.pack_documents(odd)
    out = packing.placements(packed).collect()
    assert sum(r["n_words"] for r in out) == sum(len((t or "").encode().split()) for _, t in ODD)
    assert sum(r["doc_id"] == 5 for r in out) == 5 and all((r["bin_id"] is None) == (r["n_words"] == 0) for r in out)
    assert sum(r["doc_id"] is None for r in out) == 1 and sum(r["doc_id"] == 4 for r in out) == 2
    assert packing.pack_documents(odd.limit(0)).count() == 0
    # The sequences hold every word of every text once, where the pieces say.
    found = {}
    for r in packed.collect():
        w = r["text"].encode().split()
        assert len(w) == r["n_words"] and (r["capacity"] is None or len(w) <= r["capacity"])
        for x in r["pieces"]:
            if x["n_words"]:
                found.setdefault(x["doc_id"], []).append((x["piece"], w[x["position"] : x["position"] + x["n_words"]]))
    for i in (5, 6, 7, None):
        assert [w for _, part in sorted(found[i]) for w in part] == next(t for k, t in ODD if k == i).encode().split()


def test_packing_opens_the_cheapest_length():
    def opened(sizes, lengths=packing.LENGTHS):
        bins = packing.Bins(sizes, lengths)
        for n in sorted(sizes, reverse=True):
            bins.place(n)
        return bins.opened, [bins.holds(x) for x in bins.used]

    assert opened([2000, 1020]) == ([2048, 1024], [2048, 1024])  # 4096 would waste 1076 positions
    assert opened([2000, 2000, 40, 40]) == ([4096], [4096])  # together 4080 of 4096
    assert opened([1300] * 3) == ([4096], [4096]) and opened([1000]) == ([1024], [1024])
    assert opened([600] * 3) == ([2048], [2048]) and opened([500, 500]) == ([1024], [1024])
    # Against every way to pack a few pieces: never more than a quarter above the least cost.
    rng = random.Random(11)
    lengths = (4, 8, 16)

    def cheapest(sizes):
        best = [float("inf")]

        def go(i, bins):
            if i == len(sizes):
                best[0] = min(best[0], sum(min(n for n in lengths if n >= b) for b in bins))
                return
            for k in range(len(bins)):
                if bins[k] + sizes[i] <= 16:
                    go(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
            go(i + 1, [*bins, sizes[i]])

        go(0, [])
        return best[0]

    paid = least = 0
    for _ in range(40):
        sizes = [rng.randint(1, 12) for _ in range(7)]
        where, _, capacity = packing.pack(sizes, lengths, 0)
        paid += sum({b: c for b, c in zip(where, capacity, strict=True)}.values())
        least += cheapest(sizes)
    assert paid <= 1.1 * least


def counts_by_hand(text):
    import re

    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    w = split(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if split(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("text", [t for _, t in ODD if t is None or len(t) < 1000] + ["a b c a b c d", "x#y <b>\n\nq\nq r\x1cs\n q", "a a a a", "a b c d e f a b c"])
def test_quality_counts(text):
    assert quality.text_counts(text) == counts_by_hand(text)


def test_quality(spark, odd):
    rng = random.Random(8)
    good = [(i, words(rng, 80)) for i in range(300)]
    bad = [(1000 + i, " ".join(x.upper() + "!!" for x in words(rng, 80).split())) for i in range(300)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    m = quality.fit_quality(docs, spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad], "doc_id long, quality int, toxic int"))
    out = quality.quality_rules(docs, m).collect()
    assert np.mean([r["kept"] == (r["doc_id"] < 1000) for r in out]) > 0.99
    assert quality.keep_quality(docs, m).count() == sum(r["kept"] for r in out)
    assert quality.quality_rules(odd, m).filter("base_failed").count() == len(ODD) and quality.quality_rules(odd.limit(0), m).count() == 0
    chars, ends, slots, word_ends = textfeatures.ngram_slots(["abcd ef", None, "abcd"])
    assert ends.tolist() == [7, 7, 11] and word_ends.tolist() == [3, 3, 4] and chars[0] == chars[7] and slots[0] == slots[3]


def test_bpe(spark, odd):
    import public_tokenizers as P
    import tiktoken

    rng = random.Random(31)
    ranks = bpe.load_ranks(spark, P.path("byte_bpe_multi_50k.tiktoken"))
    v = bpe.Vocabulary(ranks)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [t for _, t in ODD] + ["It's   the   café's 12345 №½ naïve—“quoted” 漢字かな \U0001f468‍\U0001f469 <|endoftext|>", "a" * 23, "\r\n\r\n  x\t", "Donaudampfschifffahrtsgesellschaft", "a" * 129]
    texts += ["".join(rng.choices("abcdeé漢 ", k=200_000)), "".join(rng.choices("abcdefghij", k=200_000)), "".join(rng.choices("ab", k=127)), "".join(rng.choices("etaoin", k=130))]
    texts += [words(rng, 30) for _ in range(20)]
    docs = spark.createDataFrame([(2**53 + i if i else None, t, "words") for i, t in enumerate(texts)], "doc_id long, text string, texts string").repartition(2)
    for size, shared in ((bpe.CHUNK, bpe.SHARED), (500, 40)):  # one chunk each, and many that share words
        encoded = bpe.encode(docs, v, P.PATTERN, size=size, shared=shared)
        data = {r["doc_id"]: bytes(r["data"]) for r in bpe.decode(encoded, v).collect()}
        out = bpe.digests(encoded, v).collect()
        assert len(out) == len(texts)
        for r in out:
            t = texts[(r["doc_id"] or 2**53) - 2**53] or ""
            ids = enc.encode_ordinary(t)
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()), t[:40]
            assert data[r["doc_id"]] == t.encode()
    assert bpe.digests(bpe.encode(odd.limit(0), v, P.PATTERN), v).count() == 0
    for k in (1, 2, 50, 1000):
        w = "".join(rng.choices("abet", k=k)).encode()
        assert bpe.heap_fold(w, ranks) == enc.encode_ordinary(w.decode())


def test_bpe_matches_each_part_once():
    P = pytest.importorskip("public_tokenizers")
    regex = pytest.importorskip("regex")
    assert P.PATTERN in bpe.SPACED
    cut, rng = regex.compile(P.PATTERN), random.Random(5)
    signs = [" ", " ", "  ", "\n", "\t", "a", "b", "\u00e9", "1", ".", "'s", "'", "\x1c", "\x85", "\u00a0", "\u3000", "\u200b", "\r\n"]
    for _ in range(500):
        texts = ["".join(rng.choices(signs, k=rng.randint(0, 12))) for _ in range(6)]
        words, at = bpe.pieces_of(pa.array(texts, pa.string()), cut.findall, True)
        words = [w.decode() for w in words.to_pylist()]
        assert [[words[i] for i in a] for a in at.to_pylist()] == [cut.findall(t) for t in texts] and len(set(words)) == len(words)
    calls = []
    bpe.pieces_of(pa.array(["some words here"] * 50), lambda t: calls.append(t) or cut.findall(t), True)
    assert sum(map(len, calls)) < 300  # not once per occurrence


def test_bpe_finds_whole_words_that_no_merge_makes(spark):
    import tiktoken

    ranks = {bytes([i]): i for i in range(256)} | {b"bc": 256, b"abc d"[:3] + b"z": 257, b"ab": 258, b"abq": 259}
    v = bpe.Vocabulary(ranks)
    enc = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    texts = ["abcz abc abq", "abczabcz bc", "abq"]
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), v, r"\S+|\s+").collect()}
    assert v.whole == {b"abcz": 257} and all(got[i] == enc.encode_ordinary(t) for i, t in enumerate(texts))


def test_ids_beside_nulls(spark):
    """An id above 2**53 in one batch with a null id stays as it is in every operator that returns ids."""
    big = 2**53 + 1
    docs = spark.createDataFrame([(None, words(random.Random(1), 60)), (big, words(random.Random(2), 60)), (big + 2, None)], "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    vectors = spark.createDataFrame([(None, [1.0]), (big, [2.0]), (big + 2, [3.0])], "vec_id long, embedding array<double>").coalesce(1)
    results = [
        toxicity.toxicity(docs, toxicity.fit_toxicity(docs, labels)), lmscore.pseudo_likelihood(docs, lmscore.fit_network(docs)), simhash.near_duplicates(docs), packing.placements(packing.pack_documents(docs)),
        quality.quality_rules(docs, quality.fit_quality(docs, labels)), linededup.removed_lines(docs), sharding.shard_documents(docs), html.main_text(pages, html.train(20)).withColumnRenamed("page_id", "doc_id"),
    ]
    for out in results:
        assert {r["doc_id"] for r in out.select("doc_id").collect()} == {None, big, big + 2}
    assert {(r["query_id"], r["vec_id"]) for r in nndescent.nearest(vectors, vectors.select(F.col("vec_id").alias("id"))).collect()} == {(big, big + 2), (big + 2, big)}


def test_lines(spark, odd):
    rng = random.Random(9)
    base = [words(rng, 60) for _ in range(30)]
    docs = [(i, "\n".join([base[i], "Shared line for all of us", f"own {words(rng, 8)}"])) for i in range(30)]
    for i in range(10):
        w = base[i].split(" ")
        w[5] += "x"
        docs.append((100 + i, "\n".join([" ".join(w).upper() if i == 0 else base[i], "shared LINE for all of us"])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r["doc_id"]: r["removed"] for r in linededup.removed_lines(df).collect()}
    assert out[0] == [] and all(out[i] == [1] for i in range(1, 30)) and all(out[100 + i] == [0, 1] for i in range(1, 10)) and 1 in out[100]
    kept = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(df).collect()}
    assert kept[0] == docs[0][1] and kept[101] == "" and kept[1] == docs[1][1].replace("\nShared line for all of us", "")
    some = linededup.removed_lines(odd).collect()
    assert len(some) == len(ODD) and next(r for r in some if r["doc_id"] == 7)["removed"] == [1]
    assert linededup.removed_lines(odd.limit(0)).count() == 0
    plan = linededup.dedup_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_lines_and_white_space(spark):
    """Tabs and carriage returns are white space: blank lines stay, and runs of white space are one gap."""
    rows = [(1, "alpha beta gamma\n\t\nsome line\n\t\n\r", "x"), (2, "alpha  beta\tgamma\nanother one", "y"), (None, None, "z"), (3, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _removed string").withColumn("_doc", F.lit(1)).withColumn("_th", F.lit(2)).withColumn("root", F.lit(3))
    assert {r["doc_id"]: r["removed"] for r in linededup.removed_lines(df).collect()} == {1: [], 2: [0], None: [], 3: []}
    out = linededup.dedup_lines(df)
    assert out.columns == df.columns and {r["doc_id"]: r["text"] for r in out.collect()} == {1: rows[0][1], 2: "another one", None: None, 3: ""}


def brute_line_groups(lines):
    """Groups of lines (lower case, split at single spaces) by word-level edit similarity of 0.8, all pairs."""
    split = {x: x.lower().split(" ") for x in lines}

    def linked(x, y):
        a, b = split[x], split[y]
        most = max(len(a), len(b)) // 5
        row = list(range(len(b) + 1))
        for i, w in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, v in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (w != v))
        return row[-1] <= most

    return roots_of(lines, [(x, y) for x, y in itertools.combinations(lines, 2) if abs(len(split[x]) - len(split[y])) <= max(len(split[x]), len(split[y])) // 5 and linked(x, y)])


def edited(rng, line, edits):
    w = line.split(" ")
    for _ in range(edits):
        at = rng.randrange(len(w))
        kind = rng.choice("sid") if len(w) > 1 else "s"
        w[at : at + (kind != "i")] = [] if kind == "d" else [words(rng, 1)]
    return " ".join(w)


def test_lines_against_brute_force(spark):
    """Lines with up to a fifth of their words changed, short words only, and crowded buckets of unrelated lines."""
    rng = random.Random(21)
    lines = []
    for _ in range(40):
        base = words(rng, rng.choice([4, 5, 6, 9, 10, 14, 19, 30, 60, 100]))
        n = len(base.split(" "))
        lines += [base] + [edited(rng, base, rng.randint(1, max(1, n // 5))) for _ in range(3)]
    lines += [" ".join(rng.choices(["a", "of", "to", "in", "is"], k=rng.randint(3, 8))) for _ in range(60)]
    lines += [f"{a} common start of all {words(rng, 6)}" for a in ("the", "a") for _ in range(20)]
    lines = sorted(set(lines))
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    root = brute_line_groups(lines)
    first = {}
    for i, x in enumerate(lines):
        first.setdefault(root[x], i)
    out = {r["doc_id"]: r["removed"] for r in linededup.removed_lines(docs).collect()}
    assert {i for i, r in out.items() if r} == {i for i, x in enumerate(lines) if first[root[x]] != i}


def test_lines_meet_in_crowded_buckets(spark):
    """Two near copies meet although their buckets hold smaller and larger unrelated nodes; blocks change nothing."""
    rng = random.Random(5)
    start = words(rng, 12)
    lines = [f"{start} {words(rng, 18)}" for _ in range(60)]
    copies = [edited(rng, x, 1) for x in lines[:20]]
    every = sorted(set(lines + copies))
    docs = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    found = linededup.document_lines(docs, "doc_id", "text")
    nodes = linededup.line_nodes(found, linededup.word_levels(found)).withColumn("keys", F.array(F.lit(1).cast("long"))).cache()
    want = len(set(brute_line_groups(every).values()))
    for block in (2048, 7):
        roots = {r["node"]: r["root"] for r in linededup.node_links(docs, nodes, "doc_id", "text", block).collect()}
        assert len(set(roots.values())) + len(every) - len(roots) == want


def test_line_keys_are_counted_in_shares(spark):
    """Every word pair of several nodes is found once, no other, and each share is a small table that goes when asked."""
    rng = random.Random(8)
    nodes = spark.createDataFrame([(i, sorted({rng.randrange(300) for _ in range(6)})) for i in range(100)], "node long, keys array<long>")
    shares = linededup.repeated_keys(nodes)
    counts = collections.Counter(k for r in nodes.collect() for k in r["keys"])
    found = [[r["key"] for r in x.collect()] for x in shares]
    assert len(found) == linededup.PASSES and all(found) and sorted(sum(found, [])) == sorted(k for k, n in counts.items() if n > 1)
    paths = [x._tessella_path for x in shares]
    assert all(os.path.isdir(x) for x in paths)
    linededup.forget(*shares)
    assert not any(os.path.exists(x) for x in paths)


def test_line_members_are_exchanged_in_shares(spark, monkeypatch):
    rng = random.Random(23)
    rows = []
    for i in range(30):
        line = words(rng, 20).split(" ")
        rows += [(3 * i + j, " ".join([*line[:j], "x", *line[j + 1 :]])) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = linededup.document_lines(docs, "doc_id", "text")
    nodes = linededup.line_nodes(found, linededup.word_levels(found)).cache()
    keys = []
    leaders = linededup.leader_pairs
    monkeypatch.setattr(linededup, "leader_pairs", lambda n, repeated, *more: keys.append({r["key"] for r in repeated.collect()}) or leaders(n, repeated, *more))
    roots = {r["node"]: r["root"] for r in linededup.node_links(docs, nodes, "doc_id", "text").collect()}
    assert len(set(roots.values())) == 30 and len(roots) == 90
    assert len(keys) == linededup.PASSES and all(keys) and sum(map(len, keys)) == len(set().union(*keys))


def test_thinned_finds_every_member(spark):
    some = spark.range(0, 60_000, 7).withColumnRenamed("id", "key")
    kept = {r["key"] for r in linededup.thinned(spark.range(60_000).withColumnRenamed("id", "key"), "key", some).collect()}
    assert kept >= set(range(0, 60_000, 7)) and len(kept) < 8_800  # 8,572 members, and a few by a clash
    empty = linededup.thinned(some, "key", some.limit(0))
    assert empty.count() == 0 and empty.columns == ["key"]
    assert "_bits" not in empty.columns


def test_filter_of_few_keys_is_small(spark, monkeypatch):
    """What the driver collects and broadcasts goes by the number of keys: hashed keys would reach every row of a full-size filter."""
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(linededup.F, "broadcast", lambda d: sent.append(d) or broadcast(d))
    some = spark.range(3000).select((F.col("id") * 20).alias("key"))
    kept = {r["key"] for r in linededup.thinned(spark.range(60_000).withColumnRenamed("id", "key"), "key", some).collect()}
    assert kept >= set(range(0, 60_000, 20)) and len(kept) < 3100
    assert len(sent) == 1 and sent[0].count() <= 128  # rows of 4 kB; the filter at its largest has 2,048


def test_release_returns_freed_native_memory(spark):
    """The C library would keep freed blocks: in the pipeline, some 200 MB of the driver's memory."""
    from pathlib import Path

    from tessella.llm.common import release

    jvm = spark._jvm
    held = jvm.java.lang.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    held.setAccessible(True)
    unsafe, pid = held.get(None), jvm.java.lang.ProcessHandle.current().pid()
    malloc = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) / 1024
    release(spark)
    before = malloc()
    blocks = [unsafe.allocateMemory(100_000) for _ in range(1500)]
    for b in blocks:
        unsafe.setMemory(b, 100_000, 1)
    for b in blocks[:-1]:  # the last one keeps the top of the arena in use
        unsafe.freeMemory(b)
    kept = malloc()
    release(spark)
    after = malloc()
    unsafe.freeMemory(blocks[-1])
    assert kept - before > 100 and kept - after > 100, (before, kept, after)


def test_pipeline_on_small_table(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "quality rules", "line dedup", "SimHash near-dedup", "best-fit packing"]
    out = p.run(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    assert rows and {r["capacity"] for r in rows} <= {None, *packing.LENGTHS} and sum(len(r["text"].encode().split()) for r in rows) == sum(r["n_words"] for r in rows) > 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").columns == docs.columns
