"""Language, quality, main text and the pipeline: held-out accuracy, and brute force where there is one."""

from __future__ import annotations

import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lanternlog.llm import html_extract, language_id, quality, simhash
from llm import odd

SF = os.environ.get("LANTERN_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_grams_by_hand():
    keys, counts = language_id.grams("Ab 1 a")
    code = lambda s: sum((1 if c == "_" else ord(c)) << (21 * i) for i, c in enumerate(reversed(s)))
    text = "_ab_a_"
    expected = Counter(code(text[i : i + n]) for n in (1, 2, 3) for i in range(len(text) - n + 1) if text[i : i + n] != "_")
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == expected


def test_out_of_place_distance():
    grams, _ = language_id.grams("abab")
    profile = language_id.Profiles(["p", "q"], grams, np.array([np.arange(len(grams)), np.full(len(grams), 20)]), 20)
    own, counts = language_id.grams("abab")
    top = own[np.argsort(-counts, kind="stable")]
    total = sum(abs(int(np.flatnonzero(grams == g)[0]) - i) for i, g in enumerate(top))
    assert profile.predict("abab") == ("p", pytest.approx(1 - total / (20 * len(top))))


def test_language_on_held_out_documents(spark, documents):
    profiles = language_id.learn_profiles(documents)
    rows = language_id.predict(documents, profiles).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == documents.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    flipped = documents.withColumn("lang", F.when(language_id.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    again = language_id.learn_profiles(flipped)
    assert again.names == profiles.names and (again.grams == profiles.grams).all()
    sampled = language_id.learn_profiles(documents, sample=20)
    assert sampled.names == profiles.names


def test_language_odd_rows(spark, documents):
    profiles = language_id.learn_profiles(documents)
    rows = language_id.predict(odd.frame(spark), profiles).collect()
    assert len(rows) == len(odd.texts())
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert {100, 101, 102, 103, 104} <= und and all(r.score == 0 for r in rows if r.lang_pred == "und")
    kept = language_id.keep_known(odd.frame(spark), profiles)
    assert kept.columns == odd.frame(spark).columns and kept.count() == sum(r.lang_pred != "und" for r in rows)
    assert language_id.predict(odd.frame(spark, []), profiles).count() == 0
    nothing = language_id.learn_profiles(odd.frame(spark, []))
    assert {r.lang_pred for r in language_id.predict(odd.frame(spark), nothing).collect()} == {"und"}


def brute_buckets(text):
    words = [zlib.crc32(t.encode()) for t in quality.TOKENS.findall(text.lower())]
    mask = (1 << 64) - 1
    pairs = [1 if a == b else (a * 0x9E3779B97F4A7C15 + b) & mask for a, b in zip(words, words[1:], strict=False)]
    return [((x * 0xD6E8FEB86659FD93) & mask) >> 49 for x in words + pairs]


def test_features_by_hand():
    texts = [t or "" for _, t in odd.texts() if len(t or "") < 5000]
    found, begins = quality.features().of(pa.array(texts))
    for i, t in enumerate(texts):
        assert sorted(found[begins[i] : begins[i + 1]].tolist()) == sorted(brute_buckets(t))


def test_quality_model_against_brute_force(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.learn_model(documents, labels)
    rows = {r.doc_id: r.text or "" for r in documents.collect()}
    marks = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    raw, target = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for i, t in rows.items():
        np.add.at(raw, brute_buckets(t), 1)
        if marks.get(i) == (1, 0):
            np.add.at(target, brute_buckets(t), 1)
    assert np.allclose(model.ratio, np.log(target / target.sum()) - np.log(raw / raw.sum()))
    weighed = {r.doc_id: r for r in quality.weigh(documents, model).collect()}
    for i, t in list(rows.items())[:50]:
        buckets = brute_buckets(t)
        assert weighed[i].n_features == len(buckets)
        assert weighed[i].log_weight == pytest.approx(model.ratio[buckets].sum(), abs=1e-6)
    good = [weighed[i].rejected for i, m in marks.items() if m[0] == 1 and i in weighed]
    bad = [weighed[i].rejected for i, m in marks.items() if m[0] == 0 and i in weighed]
    assert sum(good) <= 0.01 * len(good) and sum(bad) >= 0.9 * len(bad)


def test_quality_on_documents_it_has_not_seen(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    half = labels.filter("doc_id % 2 = 0")
    model = quality.learn_model(documents, half)
    rows = quality.weigh(documents, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = ([r.rejected for r in rows if r.quality == q] for q in (1, 0))
    assert sum(good) <= 0.02 * len(good) and sum(bad) >= 0.8 * len(bad)


def test_resample_takes_the_largest_keys(spark, documents):
    model = quality.learn_model(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = quality.resample(quality.weigh(documents, model), share=0.3).collect()
    left = sorted((r.sample_key for r in rows if not r.rejected), reverse=True)
    picked = sorted((r.sample_key for r in rows if r.selected), reverse=True)
    assert picked == left[: int(0.3 * len(left))]
    again = quality.resample(quality.weigh(documents, model), share=0.3).collect()
    assert {r.doc_id: r.sample_key for r in rows} == {r.doc_id: r.sample_key for r in again}


def test_quality_odd_rows(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.learn_model(documents, labels)
    frame = odd.frame(spark)
    rows = quality.resample(quality.weigh(frame, model)).collect()
    assert len(rows) == len(odd.texts()) and all(r.rejected for r in rows if r.doc_id in (100, 101, 102, 103))
    assert quality.keep_good(frame, model).count() == sum(not r.rejected for r in rows)
    assert quality.resample(quality.weigh(odd.frame(spark, []), model)).count() == 0
    empty = quality.learn_model(odd.frame(spark, []), labels.limit(0))
    assert quality.keep_good(frame, empty).count() == sum(r.n_features > 0 for r in rows)


def test_html_parsing():
    source = "<DIV class='x>y'>a <b>b</b><p>c<p>d<br>e&amp;f</div><ul><li>1<li>2</ul><script>if (a<b) '</p>'</script>tail<!-- x --> <1 end"
    page = html_extract.parse(source)
    assert [t for _, t, _ in page.texts] == ["a b", "c", "d e&f", "1", "2", "tail <1 end"]
    assert [page.tags[n] for n, _, _ in page.texts] == ["div", "p", "p", "li", "li", "html"]
    assert html_extract.parse("").texts == [] and html_extract.parse("<p").texts == []


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(9)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        parents = np.array([-1, *(rng.integers(0, i) for i in range(1, n))], np.int64)
        weight, odds = rng.integers(0, 9, n).astype(float), rng.normal(size=n)
        keep = html_extract.decode(parents, weight, odds)
        value = lambda k: float((np.where(k, 1, -1) * weight * odds).sum())
        best = -np.inf
        for bits in range(1 << n):
            k = np.array([bits >> i & 1 for i in range(n)], bool)
            if all(not k[i] or parents[i] < 0 or k[parents[i]] for i in range(n)):
                best = max(best, value(k))
        assert all(not keep[i] or parents[i] < 0 or keep[parents[i]] for i in range(n))
        if keep[0]:
            assert value(keep) == pytest.approx(best)


def test_trees_learn_a_rule():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = html_extract.Trees.fit(x[:3000], y[:3000], np.ones(3000))
    assert ((model.score(x[3000:]) > 0) == (y[3000:] > 0)).mean() > 0.95


def test_main_text_of_layouts_it_has_not_seen(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = html_extract.learn(pages)
    rng = random.Random(77)
    other = ["Accept all cookies to go on, or choose what you allow.", "Copyright by the owners, all rights reserved.", "Buy two and pay one today only!"]
    right = total = 0
    for r in pages.limit(60).collect():
        source = html_extract.parse(r.html)
        main = [t for node, t, _ in source.texts if source.tags[node] in ("p", "h1") and len(t) > 30]
        if len(main) < 3:
            continue
        page = html_extract.parse(html_extract._layout(rng, main[:6], other, ["Home", "News", "Contact us"]))
        truth = {t for node, t, _ in page.texts if any(page.marks[n] >> (html_extract.KINDS + 1) & 1 for n in lineage(page, node))}
        (text,) = html_extract.extract([page], model)
        kept = set(text.split("\n")) - {""}
        right += len(kept & truth)
        total += len(kept | truth)
    assert right >= 0.9 * total


def lineage(page, node):
    while node >= 0:
        yield node
        node = page.parents[node]


def test_main_text_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = html_extract.learn(pages)
    rows = html_extract.main_text(pages, model).collect()
    assert len(rows) == pages.count()
    sources = {r.page_id: r.html for r in pages.collect()}
    for r in rows:
        page = html_extract.parse(sources[r.page_id])
        inside = [t for node, t, _ in page.texts if any(page.tags[n] == "article" for n in lineage(page, node))]
        assert r.text == "\n".join(inside) and r.n_chars == len(r.text)


def test_main_text_odd_rows(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = html_extract.learn(pages)
    schema = "page_id bigint, url string, html string, text string, n_chars string"
    rows = [(1, None, None, "x", "y"), (1, "u", "", "x", "y"), (None, "u", "<<<>>><p><p></div></p>", "x", "y"),
            (3, "u", "<div>" * 3000 + "deep text inside of it", "x", "y"), (4, "u", "<article><p>" + "word " * 100_000, "x", "y"),
            (5, "u", "<a href=\"never closed <p>text", "x", "y")]
    found = html_extract.main_text(spark.createDataFrame(rows, schema), model).collect()
    assert len(found) == 6 and [r.text for r in found][:3] == ["", "", ""]
    assert next(r for r in found if r.page_id == 4).n_chars == 5 * 100_000 - 1
    assert {r.text for r in html_extract.main_text(pages, html_extract.learn(pages.limit(0))).collect()} == {""}


def test_pipeline_against_brute_force(spark, documents):
    """Each stage on what its predecessor kept: decisions recomputed on the driver."""
    docs = documents
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "quality", "near_duplicates", "packing"]
    for name in list(stages)[:3]:
        out = stages[name](spark, docs, SF)
        assert out.columns == docs.columns
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        if name == "language_id":
            profiles = language_id.learn_bounds(docs, language_id.learn_profiles(docs))
            expected = {i for i, r in before.items() if profiles.knows(r.text or "")}
            assert len(expected) > 0.98 * len(before)
        elif name == "quality":
            model = quality.learn_model(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            means = {i: np.mean(model.ratio[brute_buckets(r.text)]) for i, r in before.items()}
            expected = {i for i, m in means.items() if m >= model.cutoff}
        else:
            prints = {i: simhash.simhash((r.text or "").encode()) for i, r in before.items()}
            expected, ids = set(), sorted(prints)
            group = {i: i for i in ids}
            changed = True
            while changed:
                changed = False
                for a in ids:
                    for b in ids:
                        if group[a] < group[b] and (prints[a] ^ prints[b]).bit_count() <= 2:
                            group[b], changed = group[a], True
            expected = {i for i in ids if group[i] == i}
        assert set(after) == expected and all(after[i] == before[i] for i in after)
        docs = spark.createDataFrame(list(after.values()), docs.schema)
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}


def test_near_duplicate_stage_decides_per_row(spark):
    """Repeated ids, repeated rows and null ids: one row of each group stays, whatever other texts share its id."""
    texts = {"A": "one two three four five six", "B": "seven eight nine ten eleven", "C": "a b c d e f g", "D": "p q r s t"}
    rows = [(1, "A"), (5, "A"), (5, "B"), (7, "C"), (7, "C"), (None, "A"), (None, "D"), (None, "D"), (9, None), (8, ""), (8, " ")]
    data = [(i, texts.get(t, t), "en", "web", n) for n, (i, t) in enumerate(rows)]
    # Rows that are equal in all columns.
    data[4] = data[3]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF)
    assert out.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text) for r in out.collect())
    assert [g for g in got if g[1].strip()] == [(0, texts["D"]), (1, texts["A"]), (5, texts["B"]), (7, texts["C"])]
    assert [g[0] for g in got if not g[1].strip()] == [8]
    again = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs.repartition(5), SF)
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, out.collect()), key=repr)


def test_near_duplicate_stage_against_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([3, 40, 400]))]
        texts += [" ".join(base)] * rng.choice([1, 1, 3])
        edited = list(base)
        edited[rng.randrange(len(edited))] = "edit"
        texts.append(" ".join(edited))
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF).collect()}
    prints = [simhash.simhash(t.encode()) for t in texts]
    group = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in range(len(texts)):
            for b in range(len(texts)):
                if group[a] < group[b] and (prints[a] ^ prints[b]).bit_count() <= 2:
                    group[b], changed = group[a], True
    assert kept == {i for i, g in enumerate(group) if i == g} and len(kept) < len(texts) - 30


def test_language_bounds(spark, documents):
    """Learned on rows that are not held out, tried on those that are, on noise, and on languages that were not learned."""
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    profiles = language_id.learn_bounds(big, language_id.learn_profiles(big))
    assert max(profiles.bounds) < 0.6 and min(profiles.bounds[-2:]) > 0.3
    held = [r.text for r in big.filter(language_id.held_out()).collect()]
    assert sum(profiles.knows(t) for t in held) >= 0.995 * len(held)
    rng = random.Random(1)
    noise = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))
    foreign = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on "
        "toimittava toisiaan kohtaan veljeyden hengessä.",
        "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással "
        "szemben testvéri szellemben kell hogy viseltessenek.",
    ]
    for text in [noise(20), noise(80), noise(400), "".join(rng.choice("0123456789abcdef") for _ in range(2000)), *foreign, "", "12 34"]:
        assert not profiles.knows(text)
    for text in ("the house and the garden", "the"):
        assert profiles.knows(text)
    nothing = language_id.learn_profiles(odd.frame(spark, []))
    assert not language_id.learn_bounds(odd.frame(spark, []), nothing).knows("the")


def test_profiles_and_predictions_against_brute_force(spark, documents):
    """Counts, ranks and out-of-place distances recomputed from the definition, over a table."""
    rows = [r for r in documents.collect() if r.text is not None and len(r.text) < 4000][:80]
    table = spark.createDataFrame(rows, documents.schema)

    def grams(text):
        marked = "".join(c if c.isalpha() else " " for c in text.lower())
        marked = " " + " ".join(marked.split()) + " "
        found = Counter(marked[i : i + n] for n in (1, 2, 3) for i in range(len(marked) - n + 1))
        del found[" "]
        return found

    totals = defaultdict(Counter)
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.lang is not None:
            totals[r.lang].update(grams(r.text))
    # Ties are broken by the code of an n-gram, read as one number.
    code = lambda g: sum(({" ": 1}.get(c, ord(c))) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    order = lambda counter, size: sorted(counter, key=lambda g: (-counter[g], code(g)))[:size]
    ranks = {lang: {g: i for i, g in enumerate(order(c, 400))} for lang, c in totals.items()}
    want = {}
    for r in rows:
        top = order(grams(r.text), 300)
        if not any(c.isalpha() for c in r.text):
            want[r.doc_id] = ("und", 0.0)
            continue
        scores = {
            lang: sum(min(abs(known[g] - i), 400) if g in known else 400 for i, g in enumerate(top)) for lang, known in ranks.items()
        }
        best = min(sorted(scores), key=scores.get)
        want[r.doc_id] = (best, 1 - scores[best] / (400 * len(top)))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(table, language_id.learn_profiles(table)).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-12 for i in want)


def test_pipeline_stages_survive_odd_rows(spark):
    for rows in (odd.texts(), []):
        docs = odd.frame(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:3]:
            assert stage(spark, docs, SF).columns == docs.columns
            stage(spark, docs, SF).collect()
        corpus_pipeline.STAGES[3][1](spark, docs, SF).collect()
