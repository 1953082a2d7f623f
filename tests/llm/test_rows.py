"""WARC, mixing, language ID, PII, licences, decontamination and the pipeline against plain versions, and their edge cases."""

import base64
import gzip
import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from estrado.llm import decontam, langid, licenses, mixing, pii, sharding, simhash, suffix, warc
from estrado.llm.streams import Hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], DOCS)


def captured(spark, tmp_path, rows, least=0):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("digest", F.lit(2))
    path = str(tmp_path / "w")
    warc.write_archives(df, path, least)
    return path, warc.assemble(warc.read_records(spark, path))


def test_warc_round_trip(spark, tmp_path):
    odd = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\nñ"
    rows = [(1, "http://a/x?y", "same"), (5, "http://b/", "same"), (3, None, "same"), (4, "http://c/\r\nX: y", odd), (7, "u", None), (8, "u", "")]
    path, c = captured(spark, tmp_path, rows)
    got = {r["page_id"]: r for r in warc.digest_captures(c).collect()}
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert {i: (r["payload_bytes"], r["payload_digest"]) for i, r in got.items()} == {i: (len((t or "").encode()), sha(t)) for i, _, t in rows}
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {
        1: ("revisit", 5), 5: ("response", None), 3: ("revisit", 5), 4: ("response", None), 7: ("revisit", 8), 8: ("response", None)}
    by = {r["metadata"]["facts"]["page-id"]: r for r in c.collect()}
    assert by["4"]["response"]["payload"].decode() == odd and by["1"]["request"]["uri"] == "http://a/x?y"
    assert by["1"]["response"]["refers_to"] == by["5"]["capture_id"]


def test_warc_archives_are_cut_by_bytes(spark, tmp_path):
    rows = [(i, "http://a/", f"page {i} " * 100) for i in range(200)] + [(1000, "http://b/", "é" * 400_000), (1001, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("Digest", F.lit(1)).withColumn("_key", F.lit(2)).withColumn("n", F.lit(3))
    path = str(tmp_path / "w")
    warc.write_archives(df, path, bytes_per_file=50_000)
    sizes = sorted(len(gzip.decompress(p.read_bytes())) for p in (tmp_path / "w").glob("part-*"))
    assert len(sizes) > 20 and sizes[-2] < 100_000 and 800_000 < sizes[-1] < 900_000  # one holds the very long page
    got = {r["page_id"]: r["payload_bytes"] for r in warc.digest_captures(warc.assemble(warc.read_records(spark, path))).collect()}
    assert got == {i: len((t or "").encode()) for i, _, t in rows}


def test_warc_repeats_nulls_and_limits(spark, tmp_path):
    rows = [(1, "u", "x"), (1, "u", "x"), (None, "u", "x"), (2, "u", "yy"), (3, "u", "yy")]
    _, c = captured(spark, tmp_path, rows, least=2)
    got = warc.digest_captures(c).collect()
    assert len(got) == 5 and sum(r["record_type"] == "revisit" for r in got) == 1
    _, c = captured(spark, tmp_path / "again", rows)
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in warc.digest_captures(c).collect())
    assert [x[1:] for x in got if x[0] in (0, 1)].count(("response", None)) == 1
    _, c = captured(spark, tmp_path / "none", [])
    assert c.count() == 0


def test_warc_reads_members_and_rejects_bad_digests():
    r = b"WARC/1.1\r\nWARC-Type: request\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in warc.parse(gzip.compress(r) + gzip.compress(r))] == [b"abc", b"abc"]
    assert [b for _, b in warc.parse(r + r)] == [b"abc", b"abc"]
    with pytest.raises(ValueError):
        list(warc.parse(r[:-6]))


def plain_water(sizes, weights, budget, most):
    target, open_ = {}, dict(weights)
    while open_:
        left = budget - sum(target.values())
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            del open_[s]
    return target


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(0, 60), "en", rng.choice(["a", "b", "c", "d", None] + ["hot"] * 5)) for i in range(1500)]
    rows += [(None, "x y", "en", "a"), (None, None, None, None), (7, "p q r", "en", "b")]
    df = docs(spark, rows).withColumns({"size": F.lit(1), "target": F.lit(2), "last": F.lit(3)})
    got = mixing.plan_mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = plain_water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert r["taken"] == r["times"] * r["size"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    mix = mixing.mixed_rows(df)
    assert mix.columns == df.columns and mix.count() == sum(r["times"] for r in got)
    assert mixing.plan_mix(docs(spark, [])).count() == 0
    assert [r["target"] for r in mixing.plan_mix(docs(spark, [(1, None, None, "a"), (2, "", None, "b")])).collect()] == [0.0, 0.0]


def test_mixing_of_repeated_rows_and_rows_without_ids(spark):
    rows = [(None, "a b c d e", "en", "a")] * 500 + [(i, "x " * (1 + i % 9), "en", "b") for i in range(300)] + [(None, "y " * (1 + i % 7), "en", "c") for i in range(400)] + [(7, "k " * 3, "en", "d")] * 50
    got = mixing.plan_mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    taken, target = {}, {}
    for r in got:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 9 for s in taken), (taken, target)
    mix = mixing.mixed_rows(docs(spark, rows))
    assert mix.count() == sum(r["times"] for r in got)
    assert sorted(r["taken"] for r in mixing.plan_mix(docs(spark, rows).repartition(7)).collect()) == sorted(r["taken"] for r in got)


def test_water_level_over_many_sources(spark):
    rng = random.Random(8)
    sizes = {f"s{i:05d}": rng.choice([0, 1, 5, 40, 900]) * rng.randrange(1, 9) for i in range(21_000)}
    df = spark.createDataFrame([(f"s{s}", s, n) for s, n in sizes.items()], "skey string, source string, source_size long")
    for share in (0.05, 0.9, 1.5, 1.99, 3.0):
        budget = share * sum(sizes.values())
        got = {r["source"]: r for r in mixing.water_fill(df, budget).collect()}
        assert [got[s]["weight"] for s in sorted(sizes)[:7]] == [5, 2, 1, 5, 2, 1, 5]
        assert all(r["target"] <= 2 * r["source_size"] + 1e-9 for r in got.values())
        assert abs(sum(r["target"] for r in got.values()) - min(budget, 2 * sum(sizes.values()))) < 1e-3
        levels = {round(r["target"] / r["weight"], 6) for r in got.values() if r["target"] < 2 * r["source_size"] - 1e-9}
        assert len(levels) <= 1


def plain_rank_order(text, profiles, top):
    """Out-of-place distances in plain Python, over n-grams of words bounded by blanks."""
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    padded = " " + " ".join(low.split()) + " "
    grams = {}
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            g = padded[i : i + n]
            if g.strip() and not (n == 3 and g[1] == " ") and not (n == 1 and g == " "):
                grams[g] = grams.get(g, 0) + 1
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    mine = sorted(grams, key=lambda g: (-grams[g], code(g)))[:top]
    best = None
    for lang in sorted(profiles):
        where = {int(c): i for i, c in enumerate(profiles[lang])}
        far = sum(min(abs(where[code(g)] - i), top) if code(g) in where else top for i, g in enumerate(mine))
        if mine and (best is None or far < best[0]):
            best = far, lang, 1 - far / (top * len(mine))
    return best[1:] if best else ("und", 0.0)


def test_language_id_against_plain_distances(spark):
    src = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    profiles = langid.train(src.where(~langid.held_out()))
    rows = [(r["doc_id"], r["text"]) for r in src.collect()] + [(900, "ab ab"), (901, "x"), (902, "¿Qué?"), (903, "a" * 5000), (904, "1 2 3"), (905, None)]
    twins = {"bb": profiles[sorted(profiles)[0]], "aa": profiles[sorted(profiles)[0]]}
    for known in (profiles, twins):  # equal distances go to the first language
        for r in langid.identify(docs(spark, rows), known).collect():
            lang, score = plain_rank_order(r["text"] or "", known, langid.TOP)
            assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-9, r["doc_id"]


def test_language_id_keeps_clashing_names(spark):
    df = docs(spark, [(1, "ka ri", "xx", None), (2, None, "xx", None)]).withColumns({"Score": F.lit(7), "_lang": F.lit("k"), "_row": F.lit(1), "lang_pred": F.lit("mine")})
    profiles = langid.train(df)
    got = langid.told_rows(df, profiles)
    assert got.columns == df.columns and [(r["doc_id"], r["Score"], r["_lang"], r["lang_pred"]) for r in got.collect()] == [(1, 7, "k", "mine")]
    assert [r["lang_pred"] for r in langid.identify(df, profiles).orderBy("doc_id").collect()] == ["xx", "und"]


def test_language_id(spark):
    rng = random.Random(2)
    make = lambda syl: " ".join("".join(rng.choices(syl, k=rng.randint(1, 3))) for _ in range(40)).capitalize() + "!! 12"
    syl = {"xx": ["ka", "ri", "tó", "ne"], "yy": ["sch", "üb", "er", "og"], "zz": ["ção", "lhe", "mi", "nu"]}
    rows = [(i, make(syl[k]), k) for i in range(300) for k in [rng.choice(list(syl))]]
    df = docs(spark, rows).withColumn("held_out", langid.held_out())
    profiles = langid.train(df.where(~F.col("held_out")))
    assert list(profiles) == ["xx", "yy", "zz"]
    out = langid.identify(df.select("doc_id", "text", "lang", "held_out"), profiles)
    rows_ = out.where("held_out").collect()
    assert len(rows_) > 50 and sum(r["lang_pred"] == r["lang"] for r in rows_) >= 0.98 * len(rows_)
    assert all(0 <= r["score"] <= 1 for r in rows_)
    odd = docs(spark, [(1, None), (2, ""), (3, "123 !!"), (4, "漢字かな" * 600), (5, "ka")])
    got = {r["doc_id"]: r for r in langid.identify(odd, profiles).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[5]["lang_pred"] == "xx" and got[1]["score"] == 0
    assert langid.train(odd.limit(0)) == {} and langid.identify(odd, {}).where("lang_pred <> 'und'").count() == 0


def test_ngram_counts_by_hand_and_in_pieces(monkeypatch):
    codes, n = langid.ngrams("Ab, ab")
    name = lambda c: "".join(chr(c >> s & 0x1FFFFF) for s in (42, 21, 0) if c >> s & 0x1FFFFF)
    assert dict(zip(map(name, codes.tolist()), n.tolist())) == {"a": 2, "b": 2, " a": 2, "ab": 2, "b ": 2, " ab": 2, "ab ": 2}
    text = "palabra corta y otra más larga " * 40
    whole = dict(zip(*(x.tolist() for x in langid.ngrams(text))))
    monkeypatch.setattr(langid, "PIECE", 100)
    assert dict(zip(*(x.tolist() for x in langid.ngrams(text)))) == whole


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_pii(text):
    out = []
    for k, (name, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            if name == "ip" and not all(int(p.lstrip("0")[:4] or "0") <= 255 for p in m[0].split(".")):
                continue
            if name == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if name == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_against_expressions(spark):
    rng = random.Random(3)
    alphabet = list("0123456789012345 --..@@++()aZ_%é\n") + ["1.2.3.4", "4111 1111 1111 1111", "a@b.co", "+1 (743) 555-3824", "İ", "http://", "IBAN ", "255.255.255.255."]
    rows = [(i, "".join(rng.choices(alphabet, k=rng.randint(0, 120)))) for i in range(1500)] + [(9000, None), (9001, ""), (None, "x@y.z"), (9002, "1" * 5000), (9003, "a" * 3000 + "@" + "b" * 3000)]
    got = {r["doc_id"]: r for r in pii.scan(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = plain_pii(t)
        listed = pii.listed(want)
        assert got[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), (t, listed, got[i]["spans"])
        assert [got[i][f"n_{k}"] for k, _ in BASE] == [sum(x[1] == n for x in want) for n in range(4)]
        base = [x for x in got[i]["spans"].split(",") if x and x.split(":")[0] in dict(BASE)]
        assert ",".join(base) == listed
    assert pii.scan(docs(spark, [])).count() == 0


LONG = {"0" * 5000 + ".1.2.3": 1, "9" * 5000: 0, "9" * 1_000_000: 0, "@" * 1_000_000: 0, "+" * 1_000_000: 0, "a@" * 300_000: 0, "1." * 300_000: 75_000, "+1" * 300_000: 0, "account " * 50_000 + "1" * 20_000: 0, "token" * 200_000: 0, "1.2.3.4.5.6.7.8..1.2.3.4.": 3, "256.1.1.1.1.1.1.1": 1}


@pytest.mark.parametrize("text", LONG, ids=range(len(LONG)))
def test_pii_long_runs(text):
    base = [x for x in pii.find(text, pii.automaton()) if x[1] < pii.BASE]
    assert len(base) == LONG[text]
    if len(text) < 10_000:  # the expressions take time that grows with the square of a run
        assert base == [x for x in plain_pii(text) if x[1] < pii.BASE]


def test_pii_long_zeros_end_to_end(spark):
    assert [r["n_ip"] for r in pii.scan(docs(spark, [(1, "0" * 5000 + ".1.2.3")])).collect()] == [1]


def planted_accounts(n=300):
    """(text, the account in it or None): accounts in all the forms, and sentences with cues, years, dates and quantities."""
    rng = random.Random(9)
    digits = lambda k: str(rng.randint(1, 9)) + "".join(str(rng.randint(0, 9)) for _ in range(k - 1))
    for _ in range(n):
        bban = digits(18)
        check = 98 - int(bban + "131400") % 97  # DE00
        told = [f"DE{check:02d}{bban}", f"DE{check:02d} {bban[:4]} {bban[4:8]} {bban[8:12]} {bban[12:16]} {bban[16:]}", digits(10), f"{digits(4)}-{digits(4)}-{digits(3)}", f"AB{digits(7)}", f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", digits(7)]
        for form, value in zip(["IBAN {}", "my iban: {} please", "account {}", "Acct no. {}", "passport {}", "SSN: {}", "account number {}"], told, strict=True):
            yield f"Dear all, {form.format(value)}, thanks.", value if not pii.DATE.fullmatch(value) else None
        y, m, d = rng.randint(1950, 2029), rng.randint(1, 12), rng.randint(1, 28)
        for clean in (f"account {y} {m:02d}{d:02d}", f"passport {digits(6)}", f"on account of {digits(8)} units", f"Account {y} was closed", f"account: {d:02d}-{m:02d}-{y}", f"passports {digits(8)}", f"accounts {digits(9)}", f"iban {digits(20)}", f"ssn 000-{digits(2)}-{digits(4)}"):
            yield f"Dear all, {clean}, thanks.", None


def test_pii_accounts_recall_and_precision():
    machine, right, wrong, there = pii.automaton(), 0, 0, 0
    for text, value in planted_accounts():
        found = [text[a:b] for a, k, b in pii.find(text, machine) if pii.KINDS[k] == "account"]
        there += value is not None
        right += value is not None and found == [value]
        wrong += len(found) if value is None else len([f for f in found if f != value])
    assert right >= 0.99 * there and wrong <= 0.005 * there, (right, wrong, there)


def test_pii_urls_recall_and_precision():
    machine, urls = pii.automaton(), ["http://a.example/x", "https://b.example:80/y?z=1&w=%20#f", "ftp://c.example/d_(e)", "mailto:x@y.example", "HTTPS://D.EXAMPLE/"]
    for url in urls:
        for form in ("see {} now", "({}, or so", "{}.", '"{}"', "<{}>", "x\n{}\ny"):
            text = form.format(url)
            assert [text[a:b] for a, k, b in pii.find(text, machine) if pii.KINDS[k] == "url"] == [url]
    for clean in ("http and https", "https:/a.example", "http:// spaced", "xhttp://glued.example", "mailto: nobody"):
        assert not [k for _, k, _ in pii.find(clean, machine) if pii.KINDS[k] == "url"]


def test_pii_finds_more_kinds():
    t = "ver https://a.example/x?y=1. Account no: 12-3456-7890, mailto:a@b.co IBAN DE89 3704 0044 0532 0130 00"
    found = [(pii.KINDS[k], t[a:b]) for a, k, b in pii.find(t, pii.automaton())]
    assert ("url", "https://a.example/x?y=1") in found and ("account", "12-3456-7890") in found and ("email", "a@b.co") in found
    assert any(k == "account" and x.startswith("DE89 3704") for k, x in found)


def test_pii_checks_digits_and_finds_secrets(spark):
    found = lambda t: [(pii.KINDS[k], t[a:b]) for a, k, b in pii.find(t, pii.automaton()) if k >= pii.BASE]
    assert found("IBAN DE89 3704 0044 0532 0130 00 is mine") == [("account", "DE89 3704 0044 0532 0130 00")]
    assert found("IBAN DE88 3704 0044 0532 0130 00") == [] and found("SSN 666-12-3456, SSN: 123-00-4567") == []
    assert found("ssn 123-45-6789.") == [("account", "123-45-6789")] and found("Account no 1234567 is closed") == [("account", "1234567")]
    assert found("passport: AB1234567;") == [("account", "AB1234567")] and found("accountability 1234567") == []
    assert found('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x') == [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")]
    assert found("a token of friendship and a secret understanding") == [] and found("password: aaaaaaaaaaaaaaaaaaaa1") == []
    assert found("AKIA" + "Q7" * 8 + ".") == [("secret", "AKIA" + "Q7" * 8)]
    src = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")  # every planted secret is found, and clean texts have none
    hex_ = r'token = "([0-9a-f]{40})"'
    rows = pii.scan(src).select("doc_id", F.col("spans").contains("secret:").alias("told")).join(src, "doc_id").select("told", F.col("text").rlike(hex_).alias("planted")).collect()
    assert any(r["planted"] for r in rows) and all(r["told"] == r["planted"] for r in rows)


def test_neighbouring_licenses_are_told_apart(spark):
    text = {(i, n): t for i, n, t in licenses.TEMPLATES}
    rows = [(k, "Intro words. " + t + " And then the rest.") for k, t in enumerate(text.values())]
    got = {r["doc_id"]: (r["license_id"], r["template"], r["dice"]) for r in licenses.scan(docs(spark, rows)).collect()}
    for k, (licence, name) in enumerate(text):
        assert got[k][0] == licence and got[k][2] == 1.0, (licence, name, got[k])
    many = licenses.Templates()
    words = ("x y z released under the mit license " * 3000).split()
    ids = [many.ids.get(w, 0) for w in words]
    import numpy as np

    found = list(many.stretches(np.array([a * many.side + b if a and b else 0 for a, b in zip(ids, ids[1:])])))
    assert len(found) == 3000 and all(a[4] < b[3] for a, b in zip(sorted(found, key=lambda x: x[3]), sorted(found, key=lambda x: x[3])[1:]))


def test_licenses(spark):
    notice = next(t for i, n, t in licenses.TEMPLATES if (i, n) == ("GPL-3.0", "notice"))
    swapped = notice.replace("GNU General", "ACME General", 1).replace("terms", "rules")
    rows = [(1, "Hola.\nReleased under the MIT License.\nFin"), (2, "x " * 500 + notice + " y" * 50), (3, swapped), (4, "licensed under the moon"), (5, None), (6, ""), (7, "MIT"), (None, "LICENSED UNDER CC BY-NC 4.0!")]
    got = licenses.scan(docs(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["license_id"], r["template"]))
    assert by == {1: [("MIT", "statement")], 2: [("GPL-3.0", "notice")], 3: [("GPL-3.0", "notice")], None: [("CC-BY-NC-4.0", "statement")]}
    one = next(r for r in got if r["doc_id"] == 1)
    assert rows[0][1][one["start"] : one["end"]] == "Released under the MIT License" and one["dice"] == 1.0
    assert licenses.scan(docs(spark, [])).count() == 0


def test_whole_licenses_are_one_stretch(spark):
    whole = {i: t for i, n, t in licenses.TEMPLATES if n == "whole"}
    assert set(whole) == {"MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib"}
    rows = [(k, f"Copyright (c) 20{k} Someone\n\n{t.upper()}\n\nimport this") for k, t in enumerate(whole.values(), 10)]
    named = whole["MIT"].replace("authors or copyright holders", "ACME CORP").replace("Software", "Library")
    got = {}
    for r in licenses.scan(docs(spark, [*rows, (1, named)])).collect():
        got.setdefault(r["doc_id"], []).append((r["license_id"], r["template"]))
    assert got == {**{k: [(licence, "whole")] for k, licence in enumerate(whole, 10)}, 1: [("MIT", "whole")]}


def plain_scan(text, templates, least=0.8):
    """All windows of a text against all templates, best first; what overlaps a better one goes, and a window around several of its own licence replaces them."""
    words = [(m.group(), m.start(), m.end()) for m in licenses.WORDS.finditer(text.lower())]
    have = [(a[0], b[0]) for a, b in itertools.pairwise(words)]
    found = []
    for rank, (licence, name, t) in enumerate(templates):
        want = list(itertools.pairwise(licenses.WORDS.findall(t.lower())))
        for i in range(len(have)):
            left, common = list(want), 0
            for j in range(i, len(have)):
                if have[j] in left:
                    left.remove(have[j])
                    common += 1
                dice = 2 * common / (j - i + 1 + len(want))
                if dice >= least - 1e-12:
                    found.append((-dice, -len(want), rank, i, j))
    taken = []
    for dice, _, rank, i, j in sorted(found):
        if all(j < a or b < i for *_, a, b in taken):
            taken.append((templates[rank][0], templates[rank][1], -dice, i, j))
    for dice, _, rank, i, j in sorted(found):
        over = [x for x in taken if not (j < x[3] or x[4] < i)]
        if len(over) > 1 and all(x[0] == templates[rank][0] and i <= x[3] and x[4] <= j for x in over):
            taken = [x for x in taken if x not in over] + [(templates[rank][0], templates[rank][1], -dice, i, j)]
    return sorted((licence, name, round(dice, 9), words[i][1], words[j + 1][2]) for licence, name, dice, i, j in taken)


def test_license_scan_against_all_windows(spark):
    rng = random.Random(11)
    some = [t for t in licenses.TEMPLATES if t[1] in ("statement", "statement-2", "sentence")]
    some.append(("MIT", "both", f"{some[0][2]} {some[1][2]}"))  # contains two of its own licence
    rows = []
    for k in range(60):
        words = []
        for _ in range(rng.randrange(4)):
            words += [rng.choice(["the", "License", "MIT", "under", "x,", "y"]) for _ in range(rng.randrange(6))]
            said = rng.choice(some)[2].split()
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(said))
                said[at : at + rng.randrange(2)] = rng.choice([["z"], [], [said[at], said[at]]])
            words += said
        rows.append((k, " ".join(words)))
    got = {}
    for r in licenses.scan(docs(spark, rows), tuple(some)).collect():
        got.setdefault(r["doc_id"], []).append((r["license_id"], r["template"], round(r["dice"], 9), r["start"], r["end"]))
    want = {k: plain_scan(t, some) for k, t in rows}
    assert sum(map(len, want.values())) > 40
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_license_bounds_lose_nothing():
    """Every stretch that a full search finds is found, at least in part."""
    rng = random.Random(4)
    words = ["the", "license", "mit", "released", "under", "of", "gnu", "general", "public", "x", "y"]
    known = licenses.Templates((("MIT", "s", "Released under the MIT License now"), ("G", "g", "of the GNU General Public License")), 0.8)
    for _ in range(300):
        w = [rng.choice(words) for _ in range(40)]
        at = rng.randrange(30)
        w[at : at + 6] = rng.choice(["released under the mit license now", "of the gnu general public license", "released under the mit x now"]).split()
        ids = [known.ids.get(x, 0) for x in w]
        pairs = [a * known.side + b if a and b else 0 for a, b in zip(ids, ids[1:])]
        full = set()
        for k, (_, _, have, size, _, _, _) in enumerate(known.items):
            for i in range(len(pairs)):
                left, common = dict(have), 0
                for j in range(i, len(pairs)):
                    if left.get(pairs[j], 0):
                        left[pairs[j]] -= 1
                        common += 1
                    if 2 * common / (j - i + 1 + size) >= 0.8:
                        full.add((i, j))
        import numpy as np

        got = [(a, b) for _, _, _, a, b in known.stretches(np.array(pairs))]
        assert all(any(a <= j and b >= i for a, b in got) for i, j in full)
        assert all((a, b) in full for a, b in got)


def plain_leak(item, doc, least=13, share=0.8):
    a, b = (re.findall(r"\w+", x.lower()) for x in (item, doc))
    least = min(least, len(a))
    for shift in range(-len(a), len(b) + 1):
        same = [b[i + shift] == a[i] for i in range(len(a)) if 0 <= i + shift < len(b)]
        for i in range(len(same)):
            for j in range(i + least, len(same) + 1):
                if sum(same[i:j]) >= share * (j - i) - 1e-9:
                    return True
    return False


def test_decontamination(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.randint(15, 40)))) for i in range(30)] + [(98, None), (99, "v1 v2")]
    rows = []
    for i in range(200):
        w = say(80)
        if i % 2 == 0:
            t = items[rng.randrange(30)][1].upper().split()
            for j in range(3 if i % 4 else 6, len(t), 9):
                t[j] = "sustituida"
            w[20:20] = t[: 14 + i % 30]
        rows.append((i, ", ".join(w)))
    rows += [(500, None), (501, ""), (None, items[3][1])]
    df = docs(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("leaks", F.lit(1))
    for most in (1_000_000, 1):  # keys broadcast or joined by shuffles
        out = decontam.find_leaks(df, bench, most)
        assert out.columns == [*df.columns, "leaks"]
        got = {r["doc_id"]: {x["item_id"] for x in r["leaks"]} for r in out.collect()}
        assert len(got) == len(rows)
        for i, t in rows:
            want = {k for k, x in items if k < 90 and plain_leak(x, t or "")}
            assert got[i] == want, i
    told = decontam.leaked_rows(df.unionByName(df.limit(3)), bench).collect()
    assert {r["doc_id"] for r in told} == {i for i in got if got[i]} and len(told) >= sum(map(len, got.values()))
    kept = decontam.without_leaks(df.withColumns({"t1": F.lit("a"), "_t1": F.lit("b"), "item": F.lit("c")}), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in got if not got[i]) and kept.columns[-3:] == ["t1", "_t1", "item"]
    assert decontam.find_leaks(docs(spark, []), bench).count() == 0
    assert decontam.find_leaks(df, bench.limit(0)).where("size(leaks) > 0").count() == 0


def test_decontamination_meets_its_contract():
    # each pattern of substitutions at the 80% limit, with nothing equal beyond the stretch
    for least, lengths, masks in ((9, range(9, 13), decontam.SHORT_MASKS), (13, range(13, 21), decontam.MASKS)):
        for n in lengths:
            for gone in itertools.combinations(range(n), n // 5):
                kept = [i not in gone for i in range(n)]
                assert any(all(kept[at + k] for k, on in enumerate(m) if on == "1") for m in masks for at in range(n - len(m) + 1)), (n, gone)
    rng = random.Random(6)
    items = [(n, [f"t{n}_{i}" for i in range(n)]) for n in range(1, 31)]
    known, table, own = Hashes(), {}, {}
    for n, w in items:
        own[n] = known.of(w)
        for k, (_, low, high) in enumerate(decontam.KINDS):
            for at, h in enumerate(decontam.seeds(own[n], k).tolist() if low <= n <= high else []):
                table.setdefault((k, h), []).append((n, at))

    def leaks(words):
        doc = known.of(words)
        spots = {(n, p - at) for k in range(len(decontam.KINDS)) for p, h in enumerate(decontam.seeds(doc, k).tolist()) for n, at in table.get((k, h), [])}
        return sorted({n for n, shift in spots if decontam.stretch(own[n], doc, shift)})

    for n, w in items:
        for _ in range(200):
            size = n if n < 13 else rng.randint(13, n)
            at = rng.randrange(n - size + 1)
            part = w[at : at + size]
            for i in rng.sample(range(size), size // 5 if n >= 9 else 0):
                part[i] = "x"
            assert leaks(["y"] * 5 + part + ["z"] * 5) == [n]
        if 1 < n < 9:
            assert not leaks([*w[:-1], "x"])


CLASHES = ("fp", "key", "bucket", "cell", "node", "root", "size", "shard", "slot", "spans", "score", "lang_pred", "leaks", "t1", "seed", "_key", "_row", "_at", "_tie", "row", "times", "n")


def test_operators_take_repeated_rows_long_texts_and_clashing_names(spark):
    """Each row is answered, equal rows alike; further columns, whatever their names, change nothing."""
    long = "palabra rara número 42 de la lista, " * 6000
    rows = [(7, "uno dos tres cuatro", "es", "a")] * 3 + [(None, "uno dos tres cuatro", "es", None)] * 2 + [(8, None, None, None), (8, "", "es", "a"), (9, long, "es", "b"), (10, long + "x", "es", "b"), (11, " ", "es", "b")]
    plain = docs(spark, rows)
    df = plain.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    bench = spark.createDataFrame([(1, "uno dos tres cuatro"), (1, None), (None, "número 42 de la lista palabra rara número 42 de la lista palabra rara")], "item_id long, text string")
    profiles = langid.train(plain)
    for name, op, whole in (
        ("simhash", simhash.cluster, True), ("suffix", suffix.remove_repeats, True), ("langid", lambda d: langid.identify(d, profiles).select("doc_id", "text", "lang_pred", "score"), True),
        ("pii", pii.scan, True), ("licenses", licenses.scan, False), ("decontam", lambda d: decontam.leaked_rows(d, bench), False), ("mixing", mixing.plan_mix, True), ("sharding", lambda d: sharding.assign_shards(d, shards=2).drop("slot", "shard"), True)):
        got, want = (sorted(map(repr, op(x).collect())) for x in (df, plain))
        assert got == want, name
        assert not whole or len(got) == len(rows), name
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaked_rows(df, bench).collect()} == {(7, 1), (None, 1), (9, None), (10, None)}
    kept = simhash.near_duplicates(df)
    assert kept.columns == df.columns and sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect() if r["text"]) == [(7, rows[0][1]), (9, long), (11, " ")]


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (3, None), (None, None)]])
def test_pipeline_stages_on_odd_tables(spark, tmp_path, rows):
    import corpus_pipeline

    extra = ("score", "leaks", "lang_pred", "_lang", "_row", "_key", "_estrado_text", "_t1", "times", "block", "row")
    now = docs(spark, rows).withColumns({c: F.lit(f"own {c}") for c in extra})
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs(spark, rows).withColumns({c: F.lit(f"own {c}") for c in extra}) if k else now, "/root/testdata/sf0.001")
        assert out.columns == now.columns
        assert all(r[c] == f"own {c}" for r in out.collect() for c in extra)
    assert corpus_pipeline.STAGES[-1][1](spark, now, "/root/testdata/sf0.001").count() == len(rows)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    src = spark.read.parquet(f"{d}/documents.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    extra = src.limit(2).withColumn("doc_id", F.col("doc_id") + 90_000).unionByName(src.limit(1).withColumns({"doc_id": F.lit(90_100).cast("long"), "text": F.lit("12 34")}))
    extras = {c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in ("Score", "leaks", "lang_pred", "_lang", "_row", "_key", "_estrado_text")}
    now = src = src.unionByName(extra).withColumns(extras)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, d)
        out.write.parquet(str(tmp_path / name))
        before, now = now, spark.read.parquet(str(tmp_path / name))
        if name != "sharding":
            assert now.columns == src.columns
            assert now.where(" or ".join(f"{c} <> concat('{c}', doc_id)" for c in extras)).count() == 0
        ids, was = ({r[0] for r in x.select("doc_id").collect()} for x in (now, before))
        assert ids <= was and now.count()
        if name == "language ID":
            assert was - ids == {90_100}
        elif name == "SimHash near-dedup":
            assert not {90_000, 90_001} & ids and now.select("text").distinct().count() == now.count()
        elif name == "benchmark decontamination":
            assert all(not any(b in r["text"] for b in bench) for r in now.collect()) and was - ids
        elif name == "sharding":
            assert now.count() == before.count()
    assert corpus_pipeline.run(spark, d).count() > 0
