"""Secret scan, license scan and decontamination against brute force, with the edge cases."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from penawar.llm import decontam, licenses, queries, secrets
from tests.llm.conftest import docs_of

LONG = "lorem ipsum " * 40_000
SECRET_TEXTS = [
    (1, None), (2, ""), (3, "password = hunter2hunter"), (3, "password = hunter2hunter"), (None, "token: abcdef"),
    (4, "secret=token:abcdefgh"), (5, "é𝒳 API_KEY='x/y+z.1' then AKIA" + "A1" * 10 + " and " + "deadbeef" * 4),
    (6, "token = " + "0a" * 14), (7, LONG + "passwd=longenough" + LONG), (8, "AKIAAKIA" + "Z" * 8 + " abcdef0123"),
    (9, "ghp_" + "a" * 40 + " -----BEGIN RSA PRIVATE KEY-----"), (5, "other text under one id"), (10, "TOKEN==abc"),
]


CONTRACT = {"assign": (secrets.RULES[0].pattern, 2, 6), "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]+", 0, 24),
            "github": (r"gh[pousr]_[A-Za-z0-9]+", 0, 40), "slack": (r"xox[abprs]-[A-Za-z0-9-]+", 0, 15)}


def brute_spans(text, rules):
    out = []
    for order, r in enumerate(rules):
        pattern, group, least = CONTRACT.get(r.kind, (r.pattern, r.group, r.least))
        for m in re.finditer(pattern, text or "", re.ASCII):
            if len(m.group(group)) >= least:
                out.append((m.start(), order, m.end(), r.kind))
    return sorted(out)


def test_secret_digest_matches_brute_force(spark):
    docs = docs_of(spark, SECRET_TEXTS).withColumn("_h", F.lit(1)).withColumn("rules", F.lit("x")).withColumn("kind", F.lit("y"))
    got = sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in secrets.span_digest(docs).collect())
    want = []
    for i, t in SECRET_TEXTS:
        spans = brute_spans(t, secrets.RULES)
        name = lambda keep: ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans if k in keep)
        n = [sum(k == x for *_, k in spans) for x in ("assign", "access", "hex")]
        want.append((str(i), *n, hashlib.sha256(name({"assign", "access", "hex"}).encode()).hexdigest(),
                     name({r.kind for r in secrets.RULES})))
    assert got == sorted(want)


def test_secret_query_on_table(spark, sf001):
    rows = {r.doc_id: r for r in queries.op1_secret_scan(spark, sf001).collect()}
    docs = spark.read.parquet(f"{sf001}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        assert rows[d.doc_id].spans == ",".join(f"{k}:{a}:{b}" for a, _, b, k in brute_spans(d.text, secrets.RULES))


def test_trigram_queries_hold_for_every_match():
    assert secrets.trigram_query(r"[0-9a-f]+") == []
    for r in secrets.RULES:
        for _, t in SECRET_TEXTS:
            for m in re.finditer(r.pattern, t or "", re.ASCII):
                low = m.group(0).lower()
                assert all(any(all(g in low for g in alt) for alt in clause) for clause in secrets.trigram_query(r.pattern))
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == [frozenset({frozenset({"aki", "kia"})})]
    assert secrets.trigram_query("ab(cd|ef)?g+") == [frozenset({frozenset({"abg"}), frozenset({"abc", "bcd", "cdg"}), frozenset({"abe", "bef", "efg"})})]


def test_redaction_masks_all_spans_and_keeps_the_rest(spark):
    docs = docs_of(spark, SECRET_TEXTS).withColumn("_row", F.lit(7))
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    got = sorted((str(r.doc_id), str(r.text)) for r in out.collect())
    want = []
    for i, t in SECRET_TEXTS:
        res, seen = "", 0
        for a, _, b, _k in brute_spans(t, secrets.RULES):
            if a >= seen:
                res += t[seen:a] + "[SECRET]"
            seen = max(seen, b)
        want.append((str(i), str(t if t is None else res + t[seen:])))
    assert got == sorted(want)


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_empty_tables(spark, rows):
    docs = docs_of(spark, rows)
    items = spark.createDataFrame([], "item_id long, text string")
    n = len(rows)
    assert secrets.span_digest(docs).count() == n
    assert secrets.redact(docs).count() == n
    assert licenses.scan_licenses(docs).count() == n
    assert decontam.contamination(docs, items).count() == n
    assert decontam.decontaminate(docs, items).count() == n


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_decontamination_matches_brute_force(spark):
    item = " ".join(f"w{i}" for i in range(30))
    items = [(1, item), (2, "Ünder The x9"), (3, None), (4, ""), (2, "a second text of item two"), (5, " ".join(["rep"] * 20)), (None, "lone words here")]
    cut = " ".join(f"W{i}" for i in range(5, 22))
    texts = [(1, f"start {cut} end"), (1, f"start {cut} end"), (2, None), (3, ""), (4, "only ünder the x9!"), (4, "only Ünder the x9!"), (5, " ".join(["rep"] * 50)),
             (6, " ".join(f"w{i}" for i in range(12))), (7, LONG + cut + " " + LONG), (8, "lone words here"), (None, item), (9, "a second text of item two a second text of item two")]
    docs = docs_of(spark, texts).withColumn("words", F.lit("clash")).withColumn("token", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("gram", F.lit("x"))
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated)
                 for r in decontam.contamination(docs, bench).collect())
    want = []
    for i, t in texts:
        w, hit, ids = words(t), set(), set()
        places = {}
        for n in {min(13, len(words(x))) for _, x in items if words(x)}:
            for p in range(len(w) - n + 1):
                places.setdefault(tuple(w[p:p + n]), []).append(p)
        for k, x in items:
            v = words(x)
            n = min(13, len(v))
            for s in range(len(v) - n + 1 if v else 0):
                for p in places.get(tuple(v[s:s + n]), []):
                    hit.update(range(p, p + n))
                    ids |= {str(k)} if k is not None else set()
        want.append((str(i), len(w), len(hit), ",".join(sorted(ids)), bool(hit) and 20 * len(hit) >= len(w)))
    assert got == sorted(want)
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(w[0] for w in want if not w[4])


def test_long_item_carries_slices_alone(spark):
    """An item of 9,000 words: a shingle's row holds the words of its own windows; hits at the start, middle and end."""
    item = [f"w{i * i % 7001}x{i % 13}" for i in range(9000)]
    bench = spark.createDataFrame([("long", " ".join(item)), ("short", "two words")], "item_id string, text string")
    rows = decontam.item_shingles(bench, 13, 3)
    worst = rows.agg(F.max(F.size("near")), F.count(F.lit(1))).first()
    assert worst[0] <= 2 * 13 - 3 and worst[1] == 9000 - 2 + 1
    assert rows.where("token % 2 <> 0").count() == 0  # none is taken for the row of a whole document
    docs = docs_of(spark, [(1, " ".join(item[:13])), (2, "a " + " ".join(item[4000:4020]) + " b"), (3, " ".join(item[-13:])), (4, " ".join(item[100:112])),
                           (5, " ".join(item[7:13] + item[14:30])), (6, "Two Words")])
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontam.contamination(docs, bench).collect()}
    assert got == {1: (13, ["long"]), 2: (20, ["long"]), 3: (13, ["long"]), 4: (0, []), 5: (16, ["long"]), 6: (2, ["short"])}


def test_license_scan_matches_brute_force(spark):
    texts = [(1, None), (2, ""), (3, "Under the MIT license, under the MIT License."), (3, "Under the MIT license, under the MIT License."),
             (4, "x " * 31 + licenses.TEMPLATES[2][1]), (5, "cc by nc cc by nc"), (6, LONG + "Apache License, Version 2.0" + LONG),
             (7, "this work is under the gnu general public license version 3 licensed"), (None, "CC BY-NC 4.0"), (8, "license " * 200)]
    docs = docs_of(spark, texts).withColumn("words", F.lit(1)).withColumn("label", F.lit(2))
    got = sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9))
                 for r in licenses.scan_licenses(docs).collect())
    want = []
    for i, t in texts:
        w = words(t)
        base = [(p, label) for label, ph in licenses.PHRASES for p in range(len(w)) if w[p:p + len(ph.split())] == ph.split()]
        labels, score = {x for _, x in base}, 1.0 if base else 0.0
        for label, tm in licenses.TEMPLATES:
            v = set(tm.split())
            for b in range(len(w)):  # every block
                n = len(v & set(w[b:b + licenses.block_words(tm)]))
                if n >= licenses.required(len(v), licenses.THRESHOLD):
                    labels.add(label)
                    score = max(score, n / len(v))
        at = [p for p, _ in base]
        want.append((str(i), len(w), len(base), min(at, default=None), max(at, default=None),
                     ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), round(score, 9)))
    assert got == sorted(want, key=str) or sorted(got, key=str) == sorted(want, key=str)


def test_license_notices_at_every_shift_and_whole_templates(spark):
    """A notice spread over half a block, shifted over 64 starts; a template of 100 distinct words; notices with changes."""
    spread = " one two ".join(licenses.TEMPLATES[0][1].split()[:17])
    texts = [(k, "x " * k + spread + " y" * 30) for k in range(64)]
    hundred = " ".join(f"q{i}" for i in range(100))
    custom = (*licenses.TEMPLATES, ("hundred", hundred))
    texts += [(100, hundred), (101, " ".join(f"q{i}" for i in range(79))), (102, " ".join(f"q{i} and" for i in range(80))),
              (103, "z " * 500 + " ".join(f"q{99 - i}" for i in range(90)) + " q1" * 300)]
    whole = licenses.TEMPLATES[6][1].split()
    texts += [(200, " ".join(w for i, w in enumerate(whole) if i % 9)), (201, " ".join(whole[:len(whole) // 3]))]
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in licenses.scan_licenses(docs_of(spark, texts), templates=custom).collect()}
    want = {}
    for i, t in texts:
        w, labels, score = words(t), set(), 0.0
        for label, tm in custom:
            v = set(tm.split())
            n = max(len(v & set(w[b:b + licenses.block_words(tm)])) for b in range(len(w)))
            if n >= licenses.required(len(v), licenses.THRESHOLD):
                labels.add(label)
                score = max(score, n / len(v))
        want[i] = (",".join(sorted(labels)), round(score, 9))
    assert got == want
    assert all("mit" in got[k][0] for k in range(64)) and got[100] == ("hundred", 1.0) and got[101][0] == "" and got[102][0] == got[103][0] == "hundred"
    assert "mit" in got[200][0]
