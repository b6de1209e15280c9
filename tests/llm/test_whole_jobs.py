"""Inputs beyond what small data holds: long values, long documents, null ids."""

from __future__ import annotations

import random
import string

import pytest

from evigraph.llm import decontaminate, secrets_scan, toxicity, warc

MIXED = string.ascii_letters + string.digits


def pick(r: random.Random, chars: str, n: int) -> str:
    return "".join(r.choice(chars) for _ in range(n))


@pytest.mark.parametrize("n", [256, 1600, 20000])
def test_long_secrets_are_candidates_from_end_to_end(spark, n):
    r = random.Random(n)
    base64, hexa = pick(r, MIXED + "+/", n - 1) + "7", pick(r, "0123456789abcdef", n - 1) + "7"
    late = "a" * n + pick(r, MIXED, 40) + "7"
    key = "\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,12AB\n\n" + "\n".join(pick(r, MIXED + "+/", 64) for _ in range(n // 64)) + "\n"
    signed = "eyJ" + pick(r, MIXED, n) + "." + pick(r, MIXED, n) + "." + pick(r, MIXED, n)
    head = "-----BEGIN RSA PRIVATE KEY-----"
    texts = {  # doc_id: kind, value, the text before and after it
        1: ("base64", base64, "key ", " ends"),
        2: ("hex", hexa, "see ", " ends"),
        3: ("base64", late, "see ", " ends"),
        4: ("assigned", hexa, "token=", " ends"),
        5: ("prefixed", "ghp_" + pick(r, MIXED, n), "use ", " ends"),
        6: ("signed", signed, "bearer ", " ends"),
        7: ("private_key", key, "a " + head, "-----END RSA PRIVATE KEY----- z"),
        8: ("private_key", key, "a " + head, ""),  # cut off before its end
    }
    docs = spark.createDataFrame([(k, a + v + b) for k, (_, v, a, b) in texts.items()], "doc_id long, text string")
    forest = secrets_scan.train()
    found = {(x.doc_id, x.kind, x.start, x.end): x.is_secret for x in secrets_scan.scan(docs, forest).collect()}
    assert set(found) == {(k, kind, len(a), len(a) + len(v)) for k, (kind, v, a, _) in texts.items()}
    secret = {k[0] for k, yes in found.items() if yes}
    assert secret >= {1, 4, 5, 6, 7, 8}
    masked = {x.doc_id: x.text for x in secrets_scan.redact(docs, forest).collect()}
    assert masked == {k: a + ("[SECRET]" if k in secret else v) + b for k, (_, v, a, b) in texts.items()}


def test_secret_forms_take_linear_time_on_runs_without_an_end():
    for text in ("eyJ-" * 250000, "a" * 1000000 + "Z ", "-" * 500000, "a1" * 500000 + "!", "-----BEGIN " + " " * 500000):
        assert len(secrets_scan.candidates(text)) <= 1


@pytest.mark.parametrize("labelled", [True, False])
def test_a_clean_text_is_not_toxic_by_its_length(spark, labelled):
    r = random.Random(4)
    words = ["river", "stone", "cloud", "table", "green", "letter", "paper", "winter"]
    clean = lambda n: ". ".join(" ".join(r.choice(words) for _ in range(5)) for _ in range(n)) + "."
    texts = {k: clean(6) + (" you scoundrel." if k % 4 == 0 else "") for k in range(400)} | {1000: clean(50000), 1001: clean(50000) + " you scoundrel."}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400)], "doc_id long, quality int, toxic int")
    labels = labels if labelled else labels.limit(0)
    predicted = {x.doc_id: (x.predicted, x.n_sentences) for x in toxicity.classify(docs, labels).collect()}
    assert predicted[1000] == (0, 50000) and predicted[1001] == (int(labelled), 50001)
    assert all(predicted[k][0] == int(labelled and k % 4 == 0) for k in range(400))
    kept = {x.doc_id for x in toxicity.keep_clean(docs, toxicity.train(docs, labels)).collect()}
    assert kept == {k for k, (toxic, _) in predicted.items() if not toxic}


def test_items_without_id_hit_but_are_not_named(spark):
    a, b = " ".join(f"a{k}" for k in range(12)), " ".join(f"b{k}" for k in range(12))
    bench = spark.createDataFrame([(7, a), (None, a), (None, b), (None, b), (5, "short one")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {a} y {b} short one"), (2, b), (3, "clean"), (4, "a short one")], "doc_id long, text string")
    found = {r.doc_id: (len(r.hits), r["items"]) for r in decontaminate.find_contamination(docs, bench).collect()}
    assert found == {1: (26, ["5", "7"]), 2: (12, []), 3: (0, []), 4: (2, ["5"])}
    assert [r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()] == [3]


def test_a_revisit_without_its_response_is_an_error(spark, monkeypatch):
    pages = spark.createDataFrame([(k, None, "same " * 400) for k in range(3)], "page_id long, url string, html string")
    assert sorted(r.record_type for r in warc.round_trip(pages).collect()) == ["response", "revisit", "revisit"]
    plan = warc.plan_revisits
    monkeypatch.setattr(warc, "plan_revisits", lambda df: plan(df).where("record_type = 'revisit'"))
    with pytest.raises(Exception, match="no response for the revisit record"):
        warc.round_trip(pages).collect()


def test_a_revisit_has_the_length_of_its_response_not_of_its_header(spark, monkeypatch):
    pages = spark.createDataFrame([(k, None, "same " * 400) for k in range(3)], "page_id long, url string, html string")
    plan = warc.plan_revisits
    monkeypatch.setattr(warc, "plan_revisits", lambda df: plan(df).selectExpr("* except (payload_bytes)", "7L as payload_bytes"))
    assert {r.payload_bytes for r in warc.round_trip(pages).collect()} == {2000}
