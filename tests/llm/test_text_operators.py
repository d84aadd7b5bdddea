"""Quality, secrets and token files against plain Python."""

import hashlib
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pagelake.llm import quality, secrets, token_files
from pagelake.session import scratch_path
from . import cases


def plain_figures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)} if len(windows) < 600 else set()
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))


def test_plain_figures(spark):
    rows = cases.awkward_rows() + [
        (20, "a b\na b\n\na b \n \n" + "x y z " * 9, "en", "a"), (21, "# | <b> 100% & $ *", "en", "a"),
        (22, " ".join(["p q r s t u v w"] * 3), "en", "a"), (23, "only eight words are in this short text", "en", "a"),
    ]
    got = quality.judge(cases.table(spark, rows)).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted((str(r.doc_id), *(r[c] for c in names)) for r in got) == sorted((str(i), *plain_figures(t)) for i, t, *_ in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def js(p, q):
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    kl = lambda a: np.sum(a[a > 0] * np.log2(a[a > 0] / m[a > 0]))
    return np.sqrt(max(0, (kl(p) + kl(q)) / 2))


def test_distances_reject_junk_and_keep_prose(spark):
    clean = [(i, cases.prose(200), "en", "a") for i in range(30)]
    junk = [(100, " ".join(w + "###" for w in clean[0][1].split()), "en", "a"), (101, " | ".join(["zorbel", "mirkun"] * 90), "en", "a")]
    rows = clean + junk
    got = {r.doc_id: r for r in quality.judge(cases.table(spark, rows)).collect()}
    assert all(got[i].kept for i in range(30)) and not got[100].kept and not got[101].kept
    hist = {i: quality.measure(t.encode()) for i, t, *_ in rows}
    passing = [i for i in hist if not got[i].base_failed]
    for name, at in (("char_distance", 5), ("word_distance", 6)):
        ref = sum(hist[i][at] for i in passing)
        assert got[3][name] == pytest.approx(js(hist[3][at], ref), abs=1e-9)


def test_quality_of_nothing(spark):
    assert quality.judge(cases.empty(spark)).collect() == []


def plain_spans(text):
    """The rules one by one, each match found with a search from the end of the one before."""
    found = []
    for k, (kind, pattern, group, least) in enumerate(secrets.RULES["2"]):
        rule, at = re.compile(pattern, re.A | re.I if kind == "assign" else re.A), 0
        while m := rule.search(text, at):
            at = m.end()
            if len(m[group]) >= least:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(found)]


SECRETS = [
    (30, 'é password = "abcdef12" secret=tok secret=token =abcdefgh PASSWD:\'longenough\'', "en", "a"),
    (31, "AKIA" + "Z" * 16 + " AKIA123 " + "0a" * 12 + " " + "0a" * 11, "en", "a"), (32, "api_key:abcdef apikey: ABC_DEF", "en", "a"),
    (33, "-----BEGIN RSA PRIVATE KEY-----", "en", "a"), (34, "ſecret=abcdefg toKen=abcdefg", "en", "a"),
]


def test_spans(spark):
    rows = cases.awkward_rows() + SECRETS
    versions = cases.table(spark, rows).selectExpr("doc_id AS path", "0L AS version", "text")
    got = secrets.digest(secrets.scan_versions(versions, secrets.empty_ledger(spark))).collect()
    want = []
    for i, t, *_ in rows:
        spans = plain_spans(t or "")
        base = [s for s in spans if s.split(":")[0] in ("assign", "access", "hex")]
        want.append((str(i), ",".join(spans), hashlib.sha256(",".join(base).encode()).hexdigest(), len([s for s in base if s[0:2] == "as"])))
    assert sorted((str(r.doc_id), r.spans, r.base_sha256, r.n_assign) for r in got) == sorted(want)


def test_ledger_scans_only_what_is_new(spark):
    ledger = secrets.empty_ledger(spark)
    first = spark.createDataFrame([("p", 1, "token=abcdef"), ("q", 1, "token=abcdef"), ("r", 1, None)], "path string, version long, text string")
    assert secrets.scan_versions(first, ledger, rules="1").count() == 3
    assert secrets.read_ledger(spark, ledger).count() == 2
    second = spark.createDataFrame([("s", 2, "token=abcdef"), ("r", 2, "AKIA" + "A" * 16)], "path string, version long, text string")
    found = {r.path: r.spans for r in secrets.scan_versions(second, ledger, rules="1").collect()}
    assert [s.kind for s in found["s"]] == ["assign"] and [s.kind for s in found["r"]] == ["access"]
    assert secrets.read_ledger(spark, ledger).count() == 3
    secrets.scan_versions(first, ledger, rules="2").count()
    assert secrets.read_ledger(spark, ledger).where("rules = '2'").count() == 2
    assert secrets.scan_versions(first.limit(0), ledger).collect() == []


def test_encoder_equals_the_library():
    import random

    e, rng = token_files.Encoder(token_files.tokenizer_path()), random.Random(5)
    bits = [" ", "  ", "\n", "\t", "a", "Bc", "é", "ß", "12", "'s", "'", ".", "!!", "%%%", "_", "²", "日", "\x85", " ", "\x1c", "<|endoftext|>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(5000)] + [cases.prose(300)]
    for t in texts:
        assert e(t) == np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_batches_equal_the_library(monkeypatch):
    """Odd texts together, with a memory so small that generations turn all the time."""
    import random

    monkeypatch.setattr(token_files, "REMEMBERED", 40)
    e, rng = token_files.Encoder(token_files.tokenizer_path()), random.Random(6)
    bits = [" ", "  ", "\n", " \n", "a", "Bc", "é", "ß", "12", "'s", ".", "!!", "_", "²", "ª", "日", "\x85", "<|endoftext|>", *(cases.prose(1, rng) for _ in range(80))]
    for _ in range(30):
        texts = [None, "", *("".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 30))) for _ in range(60))]
        ids, sizes = e.batch(pa.array(texts), 7)
        ends = np.cumsum(sizes)
        for t, a, b in zip(texts, ends - sizes, ends):
            assert ids[a:b].tolist() == [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 7], t


def test_other_splitters_are_left_to_the_library(tmp_path):
    from tokenizers import Tokenizer, pre_tokenizers

    other = Tokenizer.from_file(token_files.tokenizer_path())
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    other.save(str(tmp_path / "other.json"))
    e, texts = token_files.Encoder(str(tmp_path / "other.json")), ["one two", "", "three  four five."]
    assert not e.apart
    for t in texts:
        assert e(t) == np.array(other.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_token_files(spark):
    rows = cases.awkward_rows()
    path = scratch_path(spark, "tokens")
    got = token_files.token_files(cases.table(spark, rows), path).collect()
    e, ends = token_files.Encoder(token_files.tokenizer_path()), (2).to_bytes(4, "little")
    want = sorted((str(i), len(b) // 4, crc32(b)) for i, b in ((i, e(t or "") + ends) for i, t, *_ in rows))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    part = next(f for f in spark.read.parquet(path).inputFiles() if "part-" in f)
    meta = pq.ParquetFile(part.removeprefix("file://")).metadata
    columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(3)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "RLE_DICTIONARY" in columns["tokens.list.element"].encodings
    assert all(c.has_offset_index and c.has_column_index for c in columns.values())


def test_no_token_files_for_nothing(spark):
    assert token_files.token_files(cases.empty(spark)).collect() == []


def test_words_are_encoded_once_and_kept():
    """Words of a batch are encoded in one call, with and without marks, and are not encoded again after many others."""
    encoder = token_files.Encoder(token_files.tokenizer_path())
    learn, asked = encoder.learn, []
    encoder.learn = lambda fresh: (asked.append(len(fresh)), learn(fresh))
    word = lambda n: "".join(chr(97 + n // 26**k % 26) for k in range(5))
    text = lambda a, b: " ".join(["so", *(word(n) + ",." [n % 2] * (n % 3 > 0) for n in range(a, b))])
    first = encoder(text(0, 2000))
    assert asked == [2000] and first == encoder.whole(text(0, 2000))
    for at in range(2000, 602_000, 100_000):
        encoder(text(at, at + 100_000))
    asked.clear()
    assert encoder(text(0, 2000)) == first and asked == []
