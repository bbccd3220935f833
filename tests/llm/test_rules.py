"""Quality rules, resampling, decontamination, archives and the pipeline."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernlake.llm import decontaminate, quality_rules, resample, warc
from tests.llm.conftest import SCHEMA, passage

# --- quality rules -----------------------------------------------------------


def statistics(text):
    words = (text or "").encode().split()
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, covered = collections.Counter(triples), set()
    for i, t in enumerate(triples):
        if count[t] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [line for line in (text or "").split("\n") if line.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_statistics(docs, rows):
    found = quality_rules.judged(docs).collect()
    want = []
    for doc_id, text, *_ in rows:
        n = statistics(text)
        want.append((doc_id, *n, n[0] < 50 or 100 * n[4] > 50 * n[0]))
    assert sorted((tuple(r)[:7] for r in found), key=str) == sorted(want, key=str)
    assert all(not r["kept"] for r in found if r["base_failed"])


def test_outliers_go_and_the_rest_stays(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        words = [rng.choice("abcdefgh") * rng.randrange(2, 9) + str(rng.randrange(10**6)) for _ in range(rng.randrange(80, 400))]
        if i % 10 == 0:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "en", "s0" if i % 3 else "small"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    found = {r["doc_id"]: r["kept"] for r in quality_rules.judged(df).collect()}
    assert found == {i: i % 10 != 0 for i in range(900)}
    again = {r["doc_id"]: r["kept"] for r in quality_rules.judged(df.repartition(7)).collect()}
    assert again == found


def test_moderate_symbols_go_and_a_repeated_line_stays(spark):
    """20 to 40 symbols per 100 words are junk; a line that stands twice in a clean text is not."""
    rng = random.Random(3)
    rows = []
    for i in range(600):
        words = [rng.choice("abcdefgh") * rng.randrange(2, 9) + str(rng.randrange(10**6)) for _ in range(rng.randrange(100, 400))]
        text = " ".join(words)
        if i % 10 == 0:
            text = " ".join(w + "#" * (rng.random() < 0.3) for w in words)
        elif i % 10 == 1:
            text += "\n" + "\n".join([" ".join(words[:8]) + " end"] * 2)
        rows.append((i, text, "en", "s0"))
    found = quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)).collect()
    out, junk = {r["doc_id"] for r in found if not r["kept"]}, set(range(0, 600, 10))
    assert junk <= out and len(out - junk) <= 5


def test_estimate_inverts_the_covariance(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(500, 5)) @ rng.normal(size=(5, 5)) * 3000).astype(int)
    df = spark.createDataFrame([("g", *map(int, r)) for r in x], "g string, " + ", ".join(f"x{i} long" for i in range(5)))
    r = quality_rules.estimate(df).first()
    a = np.array([[r[f"a{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    cov = np.cov(x.T, bias=True) + np.diag([(f * quality_rules.SCALE) ** 2 for f in quality_rules.FLOORS])
    assert np.allclose(a @ cov @ a.T, np.eye(5), atol=1e-8)
    assert np.allclose([r[f"m{i}"] for i in range(5)], x.mean(axis=0))


def test_nearest_part(spark):
    df = spark.createDataFrame([("a", i) for i in range(100)] + [("b", 5)] * 3 + [("b", 9)], "g string, bin long")
    assert {r["g"]: r["cut"] for r in quality_rules.nearest(df, 0.75).collect()} == {"a": 74, "b": 5}


def test_rules_of_an_empty_table(no_docs):
    assert quality_rules.judged(no_docs).collect() == []


def test_rules_plan_has_no_python(docs):
    plan = quality_rules.judged(docs)._jdf.queryExecution().executedPlan().toString() + quality_rules.counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- resampling --------------------------------------------------------------


def corpus(n=1200):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        words = [rng.choice("abcdefghij") + str(rng.randrange(3000)) for _ in range(rng.randrange(60, 200))]
        if i % 5 == 0:
            for _ in range(6):
                words[rng.randrange(len(words))] = rng.choice(["grubby", "vile", "rotten"])
        rows.append((i, " ".join(words)))
    return rows


def test_resampling_by_held_out_labels(spark):
    """Labels of even rows fit the target; odd rows, never labelled, are judged."""
    df = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(0, 1200, 2)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r["selected"] for r in resample.resampled(df, labels).collect()}
    odd = [i for i in range(1200) if i % 2]
    assert sum(found[i] == (i % 5 != 0) for i in odd) / len(odd) > 0.98
    assert sum(found[i] for i in odd if i % 5) / len([i for i in odd if i % 5]) > 0.99
    again = {r["doc_id"]: r["selected"] for r in resample.resampled(df.repartition(9), labels).collect()}
    assert again == found


def test_rare_bad_words_among_many_ngrams(spark):
    """A bad word in 70 of 20,000 documents, with millions of ordinary n-grams to share buckets with."""
    drawn = np.random.default_rng(6).integers(0, 1 << 40, (20_000, 160)).tolist()
    rows = [(i, " ".join(f"{x:x}" for x in r) + " vile" * (i % 285 == 1)) for i, r in enumerate(drawn)]
    bad = {i for i, _ in rows if i % 285 == 1}
    labels = spark.createDataFrame([(i, 1, int(i in bad)) for i in range(0, 20_000, 2)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"] for r in resample.resampled(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), labels).where("not selected").collect()}
    assert len(out & bad) >= 0.9 * len(bad) and len(out - bad) <= 20


def test_top_k_is_exact(spark):
    rng = random.Random(0)
    rows = [(i, rng.choice([rng.randrange(-(10**9), 10**9), 7, 7, 8]), rng.randrange(-(2**63), 2**63)) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, key long, tie long")
    for k in (0, 1, 123, 499, 500, 900):
        want = {r[0] for r in sorted(rows, key=lambda r: (r[1], r[2]), reverse=True)[:k]}
        assert {r["doc_id"] for r in resample.top_k(df, k).where("selected").collect()} == want


def test_gumbel_keys_follow_the_weights(spark):
    """Of rows of weights 3 and 1 the first of the pair is the larger in three quarters of the draws."""
    rng = random.Random(1)
    rows = [(i, round(1000 * math.log(3)) * (i % 2), rng.randrange(-(2**63), 2**63)) for i in range(8000)]
    keys = [r["key"] for r in spark.createDataFrame(rows, "i long, lw long, tie long").withColumn("key", resample.gumbel_key(1.0)).orderBy("i").collect()]
    share = sum(b > a for a, b in zip(keys[::2], keys[1::2], strict=True)) / 4000
    assert 0.72 < share < 0.78


def test_resampling_edges(spark, docs, no_docs, rows):
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = resample.resampled(docs, no_labels).collect()
    assert len(found) == len(rows) and all(r["selected"] and r["log_weight"] == 0 for r in found)
    assert resample.resampled(no_docs, no_labels).collect() == []


# --- decontamination ---------------------------------------------------------


def shingles(text, width=5):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if width else set(), width


def test_contained_items(spark, docs, rows):
    rng = random.Random(3)
    shared = rows[5][1].split()
    items = [(1, rows[5][1]), (2, "not in " + passage(77, 30)), (3, ""), (4, None), (5, "one"), (6, " ".join(shared[3:12])), (7, " ".join(shared[:10]).upper() + "!"), (8, " ".join(shared[:40] + ["other"] * 4)), (9, " ".join(shared[:20] + ["other"] * 20)), (None, " ".join(shared[5:30])), (1, rows[5][1])]
    items += [(100 + i, " ".join(rows[16][1].split()[at : at + 30])) for i, at in enumerate(rng.sample(range(4900), 20))]
    df = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for doc_id, text, *_ in rows:
        for item_id, item in items:
            own, width = shingles(item)
            there, _ = shingles(text, width) if width else (set(), 0)
            if own and len(own & there) >= 0.8 * len(own):
                want.append((doc_id, item_id, len(own & there), len(own)))
    found = [tuple(r)[:4] for r in decontaminate.contained(docs, df).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert {w[1] for w in want} >= {1, 5, 6, 7, 8, None, 100} and 9 not in {w[1] for w in want}


def test_contained_in_blocks(spark, docs, rows, monkeypatch):
    items = spark.createDataFrame([(i, rows[5][1] + f" {i}") for i in range(12)], "item_id long, text string")
    whole = sorted(map(str, decontaminate.contained(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1000)
    assert sorted(map(str, decontaminate.contained(docs, items).collect())) == whole != []


def test_contained_in_empty_tables(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained(docs, none).collect() == []
    assert decontaminate.contained(no_docs, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).collect() == []


# --- archives ----------------------------------------------------------------


@pytest.mark.parametrize("version", [1, 2])
def test_archive(spark, version):
    import base64

    pages = [(i, f"http://h{i % 3}/ p?{i}", h) for i, h in enumerate(["<a>", "<a>", None, "", "x\r\n\r\ny", "<a>", "é" * 70000, "1 2 3\n" * 9, "a\0b"])] + [(None, None, "<a>"), (5, "http://again", "<a>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    found = warc.archive(df, version=version).collect()
    top: dict = {}
    for i, _, h in pages:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want, answered = [], set()
    for i, _, h in pages:
        data = (h or "").encode()
        response = top[h or ""] == (-1 if i is None else i) and data not in answered
        if response:
            answered.add(data)
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else top[h or ""]))
    assert sorted(((r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found), key=str) == sorted(want, key=str)
    ids = {r["record_id"] for r in found if r["record_type"] == "response"}
    assert len({r["record_id"] for r in found}) == len(pages)
    assert all(r["refers_to_id"] in ids for r in found if r["record_type"] == "revisit")
    assert {bytes(r["payload"]).decode() for r in found if r["payload"] is not None} == set(top)


def test_small_payloads_do_not_revisit(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    kinds = {r["id"]: r["record_type"] for r in warc.archive(df, revisit_from=3).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_arc_by_hand():
    """Spaces in a URL, extra line feeds, a body with what looks like a header, short dates."""
    about = b"1 0 test\nURL IP-address Archive-date Content-type Archive-length\n"
    raw = b"filedesc://x 0.0.0.0 20000101000000 text/plain %d\n" % len(about) + about + b"\n\n"
    body = b"http://no 1.1.1.1 20010101000000 text/html 5\n"
    raw += b"http://a b 1.2.3.4 200102030405 text/html %d\n" % len(body) + body + b"\nhttp://c 1.2.3.4 20010203 text/plain 0\n\n"
    found = list(warc.parse_arc(raw))
    assert [(r["URL"], r["body"]) for r in found] == [("http://a b", body), ("http://c", b"")]
    assert [warc.iso_date(r["Archive-date"]) for r in found] == ["2001-02-03T04:05:00Z", "2001-02-03T00:00:00Z"]
    with pytest.raises(ValueError):
        list(warc.parse_arc(raw[:-30]))


def test_archive_of_an_empty_table(spark):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# --- pipeline ----------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path, tokenizers_dir):
    import corpus_pipeline

    rows = [(i, t, "en", "s0", len(t)) for i, t in corpus()]
    clean = [r for r in rows if r[0] % 5]
    item = passage(50, 30)
    shared = passage(51, 40)
    rows += [(2000, clean[0][1], "en", "s0", 1), (2001, passage(52, 60) + " " + item + " " + passage(53, 20), "en", "s0", 1), (2002, passage(54, 60) + " " + shared, "en", "s0", 1), (2003, shared + "\n" + passage(55, 60), "en", "s0", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(0, 1200, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept.append({r["doc_id"]: r for r in docs.collect()})
    toxic = {i for i in range(1200) if i % 5 == 0}
    assert len(toxic & kept[0].keys()) < 6 and len(kept[0].keys() - toxic) >= len(rows) - len(toxic) - 6
    assert kept[0].keys() - kept[1].keys() == {2000} & kept[0].keys()
    assert kept[2].keys() == kept[1].keys() and kept[2][2003]["text"] == passage(55, 60) and kept[2][2003]["n_chars"] == len(passage(55, 60))
    assert kept[3].keys() == kept[2].keys() - {2001}
    assert kept[4].keys() == kept[3].keys()


def test_pipeline_of_odd_rows(spark, docs, rows, tmp_path, no_docs):
    """Nulls, ties and repeated rows pass all stages; an empty table too."""
    import corpus_pipeline

    for name, df in (("odd", docs), ("none", no_docs)):
        folder = tmp_path / name
        df.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "nothing of the kind at all here")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        found = corpus_pipeline.run(spark, str(folder)).collect()
        assert (len(found) > 0) == (name == "odd")
    assert SCHEMA
