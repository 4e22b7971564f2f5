"""Corpus operators against brute force, exact round trips and hard cases."""

import base64
import gzip
import hashlib
import io
import itertools
import json
import math
import random
import re
import struct
import time
import zipfile
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
import tiktoken
import zstandard
from pyspark.sql import functions as F

from tests.llm.cases import TEXTS, documents, nothing
from tests.oracle import rows_of, rows_of_sql
from tidelog.llm import byte_bpe, html_text, jaccard, licenses, media, mixing, pii, quality, queries, token_counts, warc
from tidelog.llm.common import split_by_keys
from tidelog.llm.components import components

FOLDER = "/root/testdata/sf0.001"


def by_id(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    assert rows_of(queries.queries()[name](spark, FOLDER)) == rows_of_sql(queries.oracle_sql()[name], FOLDER)


# media


def test_media_round_trip(spark):
    got = media.read_features(media.sniff_column(media.store_texts(documents(spark)))).collect()
    assert len(got) == len(TEXTS) + 2
    for row in got:
        assert row["payload_bytes"] % 192 == 0 and row["payload_bytes"] > 0
    by = {r["id"]: r for r in got if r["id"] is not None}
    for i, text in enumerate(TEXTS):
        if i != 3:
            raw = (text or "").encode()
            padded = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
            assert (by[i]["n_bytes"], by[i]["payload_sha256"], by[i]["tail_crc32"]) == (len(raw), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
    assert by[4]["media_sha256"] == by[5]["media_sha256"]
    assert media.store_texts(nothing(spark)).count() == 0


def test_sniffing_confirms_structure_and_carves():
    built = media.automaton()
    png, wav, bmp = (media.ENCODE[k](b"BM RIFF %PDF-1. " * 12) for k in ("image/png", "audio/wav", "image/bmp"))
    blob = b"junk BM\x00" + png + b"RIFFxxxxWAVE" + wav + b"GIF89a" + bmp + b"PK\x03\x04"
    found = media.sniff(blob, built)
    assert [f.kind for f in found] == ["image/png", "audio/wav", "image/bmp"]
    assert [blob[f.start : f.start + f.length] for f in found] == [png, wav, bmp]
    assert media.sniff(png[:-1], built) == [] and media.sniff(bytes([*png[:40], png[40] ^ 1, *png[41:]]), built) == []
    import gzip
    import io
    import zipfile

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.txt", "hello")
    gif = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
    parts = {"application/gzip": gzip.compress(b"x" * 999), "application/zip": held.getvalue(), "image/gif": gif, "image/x-portable-pixmap": b"P6\n2 1\n255\n" + bytes(6)}
    for kind, data in parts.items():
        assert [(f.kind, f.length) for f in media.sniff(b"??" + data + b"??", built)] == [(kind, len(data))]


@pytest.mark.parametrize("repeated", [*sorted(set(media.MAGIC.values())), b"PK\x03\x04" * 4 + b"PK\x05\x06" * 4, b"PK\x03\x04PK\x01\x02PK\x05\x06" + b"\0" * 18, b"\0\0\0\x08ftyp", b"\0\0\0\x08ftyp\0\0\0\x08free"])
def test_a_megabyte_of_magic_bytes_takes_seconds(repeated):
    blob = media.encode_bmp((repeated * (1 + 1_000_000 // len(repeated)))[: 5208 * media.UNIT])
    started = time.time()
    found = media.sniff(blob, media.automaton())
    assert time.time() - started < 30 and found[0].kind == "image/bmp" and found[0].length == len(blob)


def test_archives_end_where_their_own_record_says():
    parts = []
    for name in ("a", "b"):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            z.writestr(name, name * 50)
        parts.append(held.getvalue())
    member = gzip.compress(b"text " * 100_000)
    blob = b"x" + parts[0] + b"PK\x05\x06" + bytes(18) + parts[1] + member + b"tail"
    got = [(f.kind, f.start, f.length) for f in media.sniff(blob, media.automaton())]
    second = 1 + len(parts[0]) + 22
    assert got == [("application/zip", 1, len(parts[0])), ("application/zip", second, len(parts[1])), ("application/gzip", second + len(parts[1]), len(member))]


def test_sniffing_of_more_formats_and_files_within_files():
    built = media.automaton()
    segment = lambda mark, body: b"\xff" + bytes((mark,)) + struct.pack(">H", len(body) + 2) + body
    jpeg = b"\xff\xd8" + segment(0xE0, b"JFIF") + segment(0xC0, bytes(9)) + segment(0xDA, bytes(6)) + b"\x12\xff\x00\x34\xff\xd0\x56" + b"\xff\xd9"
    webp = b"RIFF" + struct.pack("<I", 4 + 8 + 6) + b"WEBPVP8L" + struct.pack("<I", 5) + bytes(6)
    page = lambda flags, body: b"OggS\x00" + bytes((flags,)) + bytes(20) + bytes((1, len(body))) + body
    ogg = page(2, b"head") + page(0, b"body") + page(4, b"end")
    box = lambda name, body: struct.pack(">I", len(body) + 8) + name + body
    mp4 = box(b"ftyp", b"isom") + box(b"moov", bytes(20)) + box(b"mdat", b"x" * 30)
    parts = {"image/jpeg": jpeg, "image/webp": webp, "audio/ogg": ogg, "video/mp4": mp4}
    for kind, data in parts.items():
        assert [(f.kind, f.start, f.length) for f in media.sniff(b"??" + data + b"\x00\x00??", built)] == [(kind, 2, len(data))]
        assert media.sniff(data[:-1] if kind != "video/mp4" else data[:39], built) == []
    png = media.encode_png(b"word " * 77 + b"more and so")[:]
    within = media.encode_wav(b"__" + png + b"__")
    found = media.sniff(b"..." + within + jpeg, built)
    assert [(f.kind, f.start, f.inside) for f in found] == [("audio/wav", 3, None), ("image/png", 3 + 44 + 2, 3), ("image/jpeg", 3 + len(within), None)]
    pdf = b"%PDF-1.4 startxref 9 %%EOF"
    assert [f.length for f in media.sniff(pdf + pdf, built)] == [len(pdf)] * 2


# mixing


def test_mix_of_hard_cases(spark):
    docs = documents(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert sorted(map(tuple, rows), key=repr) == by_id(mixing.mix(docs.repartition(5)))
    assert mixing.mix(nothing(spark)).count() == 0
    assert mixing.mix(docs.filter("doc_id < 3")).agg(F.sum("taken")).first()[0] == 0


def test_targets_are_shared_until_none_is_above(spark):
    sizes = {"a": 10, "b": 500, "c": 40, "d": 3000, None: 7}
    frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
    weights = dict(zip(["a", "b", "c", "d", None], [1, 2, 3, 1, 2], strict=True))
    want, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while True:
        share = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if share * weights[s] > 3 * sizes[s]}
        if not full:
            want |= {s: share * weights[s] for s in open_}
            break
        want |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(3 * sizes[s] for s in full)
        open_ -= full
    assert got == pytest.approx(want)


def test_small_sources_take_their_target(spark):
    sizes = {"a": 1, "b": 20, "c": 40, "d": 65, "e": 100, "f": 150, "g": 200, "h": 40_000}
    rows = [(100 * i + j, s, " ".join(["w"] * (n // 4 + (j < n % 4)))) for i, (s, n) in enumerate(sizes.items()) for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    source_of, taken, target = {k: s for k, s, _ in rows}, {}, {}
    for r in got:
        source = source_of[r["doc_id"]]
        taken[source] = taken.get(source, 0) + r["taken"]
        target[source] = r["target"]
    for source, size in sizes.items():
        assert abs(taken[source] - target[source]) <= 0.5, source
    assert all((r["first_slot"] is None) == (r["taken"] == 0) for r in got)
    # every block of a source has one slot, and every stretch of the schedule is near the shares
    words = sum(sizes.values())
    sources = mixing.source_targets(mixing.document_sizes(docs)).cache()
    slots = mixing.schedule(spark, sources, words).cache()
    shares = {r["place"]: r["high"] - r["low"] if r["high"] < 2 else 1 - r["low"] for r in sources.collect()}
    for begin, end in ((0, 100), (250, 400), (0, words // 64)):
        counts = dict(slots.filter(f"slot >= {begin} and slot < {end}").groupBy("place").count().collect())
        assert all(abs(counts.get(p, 0) - s * (end - begin)) < 4 for p, s in shares.items())
    takes, blocks = mixing.filled_slots(sources, slots, words, 64)
    filled = blocks.collect()
    assert len({r["slot"] for r in filled}) == len(filled) == sum(-(-r["takes"] // 64) for r in takes.collect())
    odd = documents(spark)
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(nothing(spark)).count() == 0
    assert mixing.mix(odd.filter("doc_id < 3")).agg(F.sum("taken")).first()[0] == 0
    kept = {r["source"] for r in mixing.repeat_documents(docs).select("source").distinct().collect()}
    assert kept == set(sizes)


def test_repeated_documents_keep_their_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = mixing.repeat_documents(docs)
    assert out.columns == docs.columns
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert out.join(docs, docs.columns, "left_anti").count() == 0


# personal data


def base_spans(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def digits(v):
        return re.sub("[^0-9]", "", v)

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(digits(v)) <= 19 and luhn(digits(v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(digits(v)) <= 15),
    ]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, text or "") if ok(m[0]))


def test_base_spans_equal_brute_force(spark):
    draw = random.Random(2)
    bits = ["a", "b.", "@", "c.d", "1", "22", "256", "255", "0001", ".", "-", " ", "+", "(", ")", "%", "4111 1111 1111 1111", "4111111111111111", "é", "", "😀", "+1 (555) 123-4567", "x@y.com", "1.2.3.4", "john@", "_"]
    texts = dict(enumerate(["".join(draw.choices(bits, k=draw.randint(0, 14))) for _ in range(1500)] + TEXTS))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["id"]: r["base"] for r in pii.find_base(frame).collect()}
    assert got == {i: base_spans(t) for i, t in texts.items()}


def test_many_matches_in_one_text_stay_linear(spark):
    text = "1.2.3.4 " * 5000
    row = pii.find_base(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_ip"] == 5000 and row["base"] == base_spans(text)


def test_revealing_terms(spark):
    texts = ["ask Zebulon at zeb@corp.example.com today"] * 4 + ["ask anyone today about Mirabel"] * 30 + ["write Mirabel at mir@corp.example.com now"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    done = {r["id"]: r for r in pii.sanitise_spans(docs).collect()}
    found = {texts[0][s["start"] : s["end"]] for s in done[0]["terms"]}
    assert "Zebulon" in found and "ask" not in found
    assert all(not done[i]["terms"] for i in range(4, 34))
    assert "Mirabel" not in {texts[34][s["start"] : s["end"]] for s in done[34]["terms"]}


def test_revealing_terms_of_whole_documents(spark):
    far = " one two three four five six seven eight "
    texts = ["Quillon" + far + "mail q@corp.example.com" + far + "then Quillon, again"] * 2  # two documents, far off
    texts += ["ask Orsina at o@corp.example.com" + far + "about Orsina"] * 12  # near in one place, far in another
    texts += ["plain Quillons" + far] * 30 + ["Quillon1 stays", "nothing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.sanitise_documents(docs.withColumn("n_chars", F.length("text").cast("long"))).collect()}
    assert out[0] == out[1] == "[TERM]" + far + "[TERM] [EMAIL]" + far + "[TERM] [TERM], [TERM]"
    assert all("Orsina" not in out[i] and "[EMAIL]" in out[i] for i in range(2, 14))
    assert all(out[i] == texts[i] for i in range(14, len(texts)))


def test_names_of_secrets_are_no_terms(spark):
    draw = random.Random(5)
    texts = [f"{'Zebulon says' if i < 20 else 'they say'} the token = {draw.getrandbits(160):040x} was seen {i}" for i in range(40)]
    texts += ["they say the river was seen"] * 300
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    done = {r["id"]: {texts[r["id"]][s["start"] : s["end"]] for s in r["terms"]} for r in pii.sanitise_spans(docs).collect()}
    assert all(done[i] == {"Zebulon", "says"} for i in range(20)) and not any(done[i] for i in range(20, 340))


def brute_spans(texts):
    """All spans of each text: base, secrets, terms."""

    def information(v):
        return sum(v.count(c) * math.log2(len(v) / v.count(c)) for c in set(v))

    secret = re.compile(r"""(?i)(?:token|secret|passw|api[_-]?key|access[_-]?key|private[_-]?key|credential)[a-z0-9_]{0,30}+["']?[ \t]{0,8}+[:=]+[ \t]{0,8}+["'`]?([a-z0-9+/_=.~-]{16,}+)""")
    word = regex.compile(r"""(?<![^\x20\x09-\x0D])([!-/:-@\[-`{-~]*+)(\p{L}{3,}+)([!-/:-@\[-`{-~]*+)(?![^\x20\x09-\x0D])""")
    rows = []
    for text in texts:
        text = text or ""
        base = base_spans(text)
        found = [x.split(":") for x in base.split(",") if x]
        found = [(k, text[int(a) : int(b)]) for k, a, b in found]
        added = [(m.start(1), m.end(1), m[1]) for m in secret.finditer(text) if re.search("[0-9]", m[1]) and information(m[1]) >= 48]
        names = set()
        for kind, value in found + [("secret", v) for *_, v in added]:
            value = value.lower() if kind == "email" else value if kind in ("ip", "secret") else re.sub("[^0-9]", "", value)
            part = {"email": value.split("@")[-1], "ip": ".".join(value.split(".")[:2]), "card": value[:6], "phone": value[:4]}.get(kind)
            names |= {f"{kind}:{value}", f"~{kind}"} | ({f"~{kind}:{part}"} if part else set())
        terms = [(m.start(2), m.end(2), m[2].lower()) for m in word.finditer(text)]
        rows.append((base, [f"secret:{a}:{b}" for a, b, _ in added], names, terms))
    rows = [(*row, [x for x in terms if not re.search("token|secret|passw|credential", x[2])]) for *row, terms in rows]
    n_term = Counter(t for *_, terms in rows for t in {x[2] for x in terms})
    n_both = Counter((t, e) for _, _, names, terms in rows for t in {x[2] for x in terms} for e in names)
    telling = {(t, e) for (t, e), n in n_both.items() if n >= (6 if e[0] == "~" else 2) and -math.log2((n + 0.5) / (n_term[t] + 1)) <= 1}
    return [",".join([*filter(None, [base]), *added, *(f"term:{a}:{b}" for a, b, t in terms if any((t, e) in telling for e in names))]) for base, added, names, terms in rows]


def test_all_spans_equal_brute_force(spark, tmp_path):
    draw = random.Random(8)
    words = [f"{a}{b}{c}" for a in ("ba", "ko", "Lu") for b in ("ne", "ri", "to") for c in ("m", "s", "x", "z")]
    texts = list(TEXTS)
    for i in range(300):
        text = draw.choices(words, k=draw.randint(0, 30))
        if i % 3 == 0:
            text += ["write", f"{draw.choice('abc')}@{draw.choice(['mail', 'post'])}.example.com"]
        if i % 7 == 0:
            text += ["token = " + draw.choice(['"', "'", ""]) + "%040x" % draw.getrandbits(160) + draw.choice(['"', " "])]
        if i % 11 == 0:
            text += ["visit 10.0.%d.1" % draw.randint(0, 2), "api_key: aaaaaaaaaaaaaaaaaaa1", "PASSWORD=hunter2"]
        draw.shuffle(text)
        texts.append(draw.choice([" ", "\n"]).join(text))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in pii.op3_pii_sanitisation(spark, str(tmp_path)).collect()}
    want = brute_spans(texts)
    assert sum("term" in w for w in want) > 50 and sum("secret" in w for w in want) > 30
    assert [got[i]["spans"] for i in range(len(texts))] == want
    assert all(r["n_spans"] == len([x for x in r["spans"].split(",") if x]) for r in got.values())


def test_sanitised_texts(spark):
    docs = documents(spark)
    out = pii.sanitise_documents(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    text = out.filter("doc_id = 6").first()["text"]
    assert text == "mail [EMAIL] or [PHONE], host [IP], card [CARD]."
    assert out.filter("doc_id = 4").first()["text"] == TEXTS[4]
    assert pii.sanitise_documents(nothing(spark)).count() == 0


# near duplicates


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 4 * both >= 3 * (len(sets[a]) + len(sets[b]) - both):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_components_equal_brute_force(spark):
    draw = random.Random(5)
    texts, words = {}, [f"w{i}" for i in range(400)]
    passage = draw.choices(words, k=40)
    for family in range(25):
        base = draw.choices(words, k=draw.randint(3, 90)) + (passage if family % 3 == 0 else [])
        for _ in range(draw.randint(1, 9)):
            copy = list(base)
            for _ in range(draw.randint(0, 5)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            texts[len(texts)] = draw.choice([" ", "\n", "\t "]).join(copy).upper() if draw.random() < 0.3 else " ".join(copy)
    texts |= {1000 + i: t for i, t in enumerate(TEXTS)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.with_component_ids(jaccard.similar_groups(frame)).collect()}
    assert got == brute_components(texts)


def test_hard_cases_of_the_join(spark):
    docs = documents(spark)
    rows = jaccard.with_component_ids(jaccard.similar_groups(docs)).collect()
    assert len(rows) == docs.count()
    assert {r["component_id"] for r in rows if r["id"] in (4, 5)} == {4}
    assert jaccard.similar_groups(nothing(spark)).count() == 0
    kept = jaccard.one_per_group(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert ids.count(4) == 1 and 5 not in ids and ids.count(8) == 1 and {0, 1, 2} <= set(ids)


def test_splits_lose_no_key(spark):
    frame = spark.range(4000).select(F.when(F.col("id") % 50 > 0, F.col("id")).alias("id"), F.lit("x").alias("bits"), F.lit(1).alias("bucket"))
    keys = spark.range(0, 4000, 37).select(F.xxhash64("id").alias("h")).unionByName(spark.range(1).select(F.xxhash64(F.lit(None).cast("long")).alias("h")))
    may, not_ = split_by_keys(frame, F.xxhash64("id"), keys)
    got = {r["id"] for r in may.collect()}
    assert may.columns == not_.columns == frame.columns and may.count() + not_.count() == 4000
    assert got >= {i for i in range(0, 4000, 37) if i % 50} | {None} and len(got) < 150
    assert split_by_keys(frame, F.xxhash64("id"), keys.limit(0))[0].count() == 0


def test_one_per_group_keeps_any_column(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "b"), (1, text, "a"), (2, text.upper(), "a"), (None, text, "a"), (None, None, None), (3, "", "a"), (4, None, "b"), (4, None, "b"), (5, "short one", "a"), (6, "short one", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit(None).cast("string"))
    for name in ("nth", "once", "kept_id", "own_hash", "copies", "row", "id", "text_hash", "root", "k", "s"):
        docs = docs.withColumn(name, F.lit(f"keep {name}"))
    kept = jaccard.one_per_group(docs)
    assert kept.columns == docs.columns and kept.join(docs, docs.columns[5:], "left_anti").count() == 0
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2] or "")
    assert sorted((tuple(r) for r in kept.select("doc_id", "text", "source").collect()), key=key) == sorted([(1, text, "a"), (None, None, None), (3, "", "a"), (4, None, "b"), (4, None, "b"), (5, "short one", "a")], key=key)
    mixed = mixing.repeat_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert mixing.repeat_documents(docs.limit(0)).count() == jaccard.one_per_group(docs.limit(0)).count() == 0


def test_word_hashes_tell_words_apart():
    draw = random.Random(4)
    words = sorted({"".join(draw.choices("abc\x00é", k=draw.choice([1, 2, 7, 8, 9, 16, 17, 40, 300]))) for _ in range(2000)})
    data = ("\n" + "\n".join(words) + " \t\n").encode()
    found, starts = jaccard.word_hashes(data)
    assert len(set(found.tolist())) == len(words) == len(starts)
    again, _ = jaccard.word_hashes(("\n " + "\r".join(reversed(words)) + "\n").encode())
    assert again[::-1].tolist() == found.tolist()


def test_the_bound_holds_and_the_tree_finds_all():
    draw = np.random.default_rng(3)
    sets = [np.unique(draw.integers(0, 3000, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for n in draw.integers(5, 1500, 150)]
    sets += [np.unique(np.append(s[: int(len(s) * 0.9)], np.uint64(i))) for i, s in enumerate(sets[:40])]
    points = [jaccard.unpacked(jaccard.packed(jaccard.point(s))) for s in sets]
    tree = jaccard.RTree(points)
    for i, s in enumerate(sets):
        found = {j for j, _ in tree.search(points[i])}
        for j, t in enumerate(sets):
            assert jaccard.bound(points[i], points[j]) >= len(np.intersect1d(s, t))
            if jaccard.linked(s, t):
                assert j in found


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(1, 30)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: (100 if n >= 100 else 0) for e in edges for n in e}


# quality


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else set(windows)
    inside = {k + j for k, w in enumerate(windows) if w in often for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_quality_equals_brute_force(spark):
    draw = random.Random(4)
    texts = dict(enumerate(TEXTS + [" ".join(draw.choices(["a", "b#", "c", "d\n", " x"], k=draw.randint(0, 60))) for _ in range(200)]))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("kept", F.lit(1))
    for r in quality.quality_rules(frame).collect():
        want = brute_quality(texts[r["id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])
    docs = documents(spark)
    assert quality.keep_documents(docs).columns == docs.columns
    assert quality.keep_documents(nothing(spark)).count() == 0


# archives


def test_archives_round_trip_and_refuse_damage(spark):
    big = "<p>" + "word " * 400
    rows = [(1, "http://a", big), (9, "http://b", big), (4, None, big), (2, "u", "short"), (3, "u", "short"), (5, "u", None), (9, "http://b", big), (None, "x", big + "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    archives = warc.write_archives(warc.mark_revisits(pages))
    got = sorted((r["record_id"], r["record_type"], r["payload_bytes"], r["refers_to"]) for r in warc.read_archives(archives).collect())
    assert ("<urn:page:1>", "revisit", len(big), "<urn:page:9>") in got and ("<urn:page:4>", "revisit", len(big), "<urn:page:9>") in got
    assert got.count(("<urn:page:9>", "response", len(big), None)) == 2
    assert [t for i, t, _, _ in got if i in ("<urn:page:2>", "<urn:page:3>", "<urn:page:5>", "<urn:page:None>")] == ["response"] * 4
    assert warc.read_archives(warc.write_archives(warc.mark_revisits(pages.limit(0)))).count() == 0
    records = [warc.write_record(i, f"u{i}", f"<html>{i} {'text ' * 50}".encode(), None) for i in range(300)]
    content = warc.write_archive(records)
    assert int.from_bytes(content[:4], "little") == warc.DICTIONARY_FRAME
    assert [r["payload"] for r in warc.read_archive(content)] == [f"<html>{i} {'text ' * 50}".encode() for i in range(300)]
    with pytest.raises((ValueError, Exception)):
        list(warc.read_archive(content[:-5]))
    with pytest.raises(ValueError):
        warc.parse_record(records[0].replace(b"text", b"tent", 1))
    with pytest.raises(ValueError):
        warc.parse_record(records[0][:-3])


def test_every_archive_has_a_dictionary():
    for count in (1, 2, 7, 300):
        records = [warc.write_record(i, "u", b"<html>" + b"x" * i, None) for i in range(count)]
        content = warc.write_archive(records)
        kind, size = struct.unpack_from("<II", content)
        assert kind == warc.DICTIONARY_FRAME and size > 0
        assert [r["record_id"] for r in warc.read_archive(content)] == [f"<urn:page:{i}>" for i in range(count)]
        # the frame may hold the dictionary compressed
        packed = zstandard.ZstdCompressor().compress(content[8 : 8 + size])
        again = struct.pack("<II", warc.DICTIONARY_FRAME, len(packed)) + packed + content[8 + size :]
        assert [r["payload"] for r in warc.read_archive(again)] == [r["payload"] for r in warc.read_archive(content)]
    # archives without a dictionary, and records longer than an archive
    long = warc.write_record(1, None, random.Random(1).randbytes(warc.ARCHIVE_BYTES + 5), None)
    assert next(warc.read_archive(zstandard.ZstdCompressor().compress(long)))["payload_bytes"] == warc.ARCHIVE_BYTES + 5


def test_copies_of_one_page_and_long_pages(spark, tmp_path):
    page = "<p>" + "word " * 300
    rows = [(i, f"http://{i}", page) for i in range(400)] + [(400 + i, None, "é" * (4 << 20)) for i in range(3)] + [(None, None, page), (None, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert by_id(warc.op6_warc_archives(spark, str(tmp_path))) == sorted(
        [(i, len(page), hashlib.sha1(page.encode()).hexdigest(), "response" if i == 399 else "revisit", None if i == 399 else 399) for i in [*range(400), None]]
        + [(400 + i, 8 << 20, hashlib.sha1(("é" * (4 << 20)).encode()).hexdigest(), "response" if i == 2 else "revisit", None if i == 2 else 402) for i in range(3)]
        + [(None, 0, hashlib.sha1(b"").hexdigest(), "response", None)],
        key=repr,
    )


# html


def test_html_extraction():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="menu-open"><header>Site name</header><nav><a href=/>Home</a></nav>
    <main><div class="cookie-notice">We use cookies &amp; more.</div><h1>Title &lt;1&gt;</h1><p>One<b>two</b>&nbsp;three.<br>four<p>Five<script>var a="</p>";</script>
    <form>Name <input></form><aside>See also</aside><section id="comments"><p>I think it was the best of all.</p></section></main><footer>&copy; x</footer></body></html>"""
    assert html_text.extract(page) == "Title <1>\nOnetwo three. four\nFive"
    for odd in ("", "<", "<p", "<!-- x", "<p>a<b", "&#x110000; &bogus;", "<div " * 3000, "<a \"" * 3000):
        html_text.extract(odd)


def test_html_keeps_what_only_looks_marked():
    text = "The river runs past the old mill and on to the sea, as it has done for a thousand years and more."
    for page in (
        f"<article class='post no-comments'><p>{text}</p></article>",
        f"<main class='with-sidebar'><p>{text}</p></main>",
        f"<article class='comments'><p>{text}</p></article>",
        f"<article><section id='discussion'><p>{text}</p></section></article>",
        f"<article><p class='share-price'>{text}</p></article>",
        f"<div id='search-results'><p>{text}</p></div>",
        f"<div class='widget'><article><p>{text}</p></article></div>",
        f"<form id='aspnetForm'><article><p>{text}</p></article></form>",
        f"<article><div class='related'><p>{text}</p></div></article>",
        f"<article><figure><img src=x><figcaption>{text}</figcaption></figure></article>",
    ):
        assert html_text.extract(page) == text, page
    marked = "<div class='sidebar'><p>A word on the side of the page.</p></div>"
    assert html_text.extract(f"<article><p>{text}</p>{marked}<div class='related'><a href=/>{text}</a></div></article><div class='ad'>{text}</div>") == text


def test_html_marks_count_however_deep():
    text = "The river runs past the old mill and on to the sea, as it has done for a thousand years and more."
    menu = "<div class=menu><p>This is the menu of the page. It has been here for years. It is not the text of it.</p></div>"
    for depth in (1, 31, 32, 33, 400):
        outer = "<div class='widget'>" * depth
        assert html_text.extract(f"{outer}<p>{text}</p><p>{text}</p>{menu}{'</div>' * depth}") == f"{text}\n{text}", depth
    assert html_text.extract(f"<article><p>{text}</p><p>Let <math><mi>x</mi></math> be the root of all that was said of the river and of the sea.</p></article>").endswith("Let x be the root of all that was said of the river and of the sea.")
    began = time.process_time()
    html_text.extract("<div class=menu><p>a b" * 60_000)
    assert time.process_time() - began < 8


def test_html_in_other_languages_and_code():
    polish = "Rzeka płynie obok starego młyna aż do morza, tak jak robiła to przez tysiąc lat albo jeszcze dłużej, mimo wojen. " * 2
    chinese = "这条河流经过古老的磨坊一直流向大海千百年来始终如此两岸的人们依靠它生活耕种捕鱼并在节日里点燃河灯祈求来年风调雨顺平安丰收阖家团圆幸福美满。" * 2
    menu = "<div><a href=/a>Dom</a> <a href=/b>Kontakt</a></div>"
    assert html_text.extract(f"<body>{menu}<p>{polish}</p></body>") == polish.strip()
    assert html_text.extract(f"<body>{menu}<p>{chinese}</p></body>") == chinese
    english = "The river runs past the old mill and on to the sea, as it has done for a thousand years and more. " * 3
    code = "for (int i = 0; i < n; i++) { total += values[i] * weights[i]; count++; } return total / count;"
    assert html_text.extract(f"<body><p>{english}</p><pre>{code.replace('<', '&lt;')}</pre></body>") == f"{english.strip()}\n{code}"


def brute_labels(blocks):
    """Both passes by plain search: (text, linked, around, inside, heading, exact) to kept or not."""

    def stops(text):
        words = re.findall(r"\w+", text.lower())
        return sum(w in html_text.STOP_WORDS for w in words) / max(1, len(words))

    own = [b for b in blocks if not b.around]
    inside = sum(len(b.text) for b in own if b.inside)
    article = inside > 0 and inside >= 0.2 * sum(len(b.text) for b in own)
    part = [b for b in own if b.inside] if article else blocks
    fits = stops(" ".join(b.text for b in part if not b.exact and not b.around)) >= (0.06 if article else 0.18)
    labels = []
    for b in part:
        linked, share, size = b.linked / len(b.text), stops(b.text), len(b.text)
        if b.around:
            labels.append("bad")
        elif article:
            if linked > 0.8:
                labels.append("bad" if size > 200 and share < 0.06 else "short")
            else:
                labels.append("short" if size < 70 else "good" if not fits or b.exact or share >= 0.18 else "near")
        elif linked > 0.33 or b.text[0] == "©":
            labels.append("bad")
        elif size < 70:
            labels.append("bad" if b.linked else "short")
        elif not fits:
            labels.append("good" if size > 200 else "near")
        else:
            labels.append(("good" if size > 200 else "near") if share >= 0.25 else "near" if share >= 0.18 or b.exact else "bad")

    def sides(labels, i):
        lean = "good" if article else "bad"
        before = [x for x in labels[:i] if x in ("good", "bad")]
        after = [x for x in labels[i + 1 :] if x in ("good", "bad")]
        return (before or [lean])[-1], (after or [lean])[0]

    second = ["good" if x == "near" and ("good" in sides(labels, i) or "good" not in labels) else "bad" if x == "near" else x for i, x in enumerate(labels)]
    last = []
    for i, x in enumerate(second):
        before, after = sides(second, i)
        last.append(x == "good" or (x == "short" and after == "good" and (part[i].heading or before == "good")))
    return "\n".join(b.text for b, kept in zip(part, last, strict=True) if kept)


def test_both_passes_equal_plain_search():
    draw = random.Random(6)
    bits = ["the river and the sea", "zorgle", "of it was", "<a href=/>home page of all</a>", "Contact", "<a href=/x>zorgle blim</a>", "© 2020"]
    seen = Counter()
    for n in range(600):
        body = ""
        for _ in range(draw.randint(0, 14)):
            tag = draw.choice(["p", "p", "li", "h2", "pre", "div class=ad", "nav"])
            body += f"<{tag}>" + " ".join(draw.choices(bits, k=draw.choice([1, 3, 8, 20]))) + f"</{tag.split()[0]}>"
            if n % 3 and draw.random() < 0.2:
                body += draw.choice(["<article>", "</article>"])
        page = f"<body>{body}</body>"
        seen.update(html_text.decide(b) for b in html_text.blocks(page))
        assert html_text.extract(page) == brute_labels(html_text.blocks(page)), page
    assert min(seen[x] for x in ("good", "bad", "near", "short")) > 50


def test_hostile_pages_stay_linear():
    for page in ("<div>" * 60_000 + "</span></p></b>" * 60_000, "<!" * 500_000, "<script " * 100_000, "<p>" * 300_000, "<a \"" * 200_000):
        began = time.process_time()
        html_text.extract(page)
        assert time.process_time() - began < 8


def test_html_hard_cases(spark):
    long_page = "<article>" + "<p>The end of the world.</p>" * 3000
    frame = spark.createDataFrame([(1, None, None), (1, "u", ""), (None, "u", long_page)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["id"]: r for r in html_text.extract_pages(frame).collect()}
    assert got[None]["n_chars"] == 3000 * len("The end of the world.") + 2999 and got[1]["text"] == ""


# tokens


def _texts():
    draw = random.Random(1)
    bits = [*"aab eEth  \n\t\r'srest▁.,0189é日本🙂ß ​　\x00\x1f ⅷ①", "<s>", "</s>", "<unk>", "<|endoftext|>", "   ", "'re", "aaaa", "ing", "tion"]
    return ["".join(draw.choices(bits, k=draw.randint(0, 60))) for _ in range(1500)] + [t or "" for t in TEXTS]


def test_token_counts_equal_the_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = _texts()
    want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    one = token_counts.PieceCounter(path)
    assert [one.count(t) for t in texts] == want
    docs = documents(spark)
    got = token_counts.count_tokens(docs, path)
    assert got.count() == docs.count() and got.filter("n_tokens = 0").count() == 2
    assert token_counts.count_tokens(nothing(spark), path).count() == 0


def test_tree_bpe_equals_the_library_and_round_trips(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tree = byte_bpe.TreeCoder(path, public_tokenizers.PATTERN)
    for text in _texts():
        ids = np.frombuffer(tree.text(text), "<u4").tolist()
        assert ids == library.encode_ordinary(text)
        assert tree.decode(ids) == text.encode()
    draw = random.Random(8)
    for _ in range(300):  # joins are exact at any cut, and associative
        data = "".join(draw.choices("abcdeinorst ", k=30)).encode()
        cuts = sorted(draw.sample(range(31), 2))
        a, b, c = (tree.window(x) for x in (data[: cuts[0]], data[cuts[0] : cuts[1]], data[cuts[1] :]))
        assert tree.join(tree.join(a, b), c) == tree.join(a, tree.join(b, c)) == tree.window(data)
    rows = {r["doc_id"]: r for r in byte_bpe.round_trip(documents(spark)).collect()}
    assert rows[6]["decoded_sha256"] == hashlib.sha256(TEXTS[6].encode()).hexdigest() and rows[0]["n_tokens"] == 0
    assert byte_bpe.round_trip(nothing(spark)).count() == 0


# licences


def test_license_scan(spark):
    files = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/code.py", "nothing here"),
        (3, "a/b/other.py", "x = 1\nLicensed under the Apache License, Version 2.0.\n" + "word " * 50),
        (4, "c/code.py", None),
        (5, None, ""),
        (6, "a/b/c/deep.py", "words only"),
        (7, "a/b/c/LICENSE", "This work is licensed under the GNU General Public License, version 3."),
        (2, "a/b/code.py", "nothing here"),
        (8, "d/x.py", "This mentions a license of no known kind whatever it may be, in a long line about other things."),
    ]
    frame = spark.createDataFrame(files, "id long, path string, text string").withColumn("license", F.lit("clash"))
    got = {r["id"]: (r["license"], r["evidence"], r["from_directory"]) for r in licenses.scan(frame).collect()}
    assert got[1] == ("MIT", "file", None) and got[2] == ("MIT", "inherited", "a") and got[3] == ("Apache-2.0", "header", None)
    assert got[4] == got[5] == got[8] == (None, "none", None)
    assert got[6] == ("GPL-3.0", "inherited", "a/b/c") and got[7] == ("GPL-3.0", "file", None)
    assert licenses.scan(frame).count() == len(files) and licenses.scan(frame.limit(0)).count() == 0


def brute_scan(files):
    """`id` to license, cosine, evidence and directory by plain loops."""

    def terms(text):
        return Counter(regex.findall(licenses.TERM, text.lower()))

    def closest(texts, templates, least):
        counted = {i: terms(t) for i, t in texts.items() if t is not None}
        counted = {i: c for i, c in counted.items() if c}
        df = Counter(t for c in counted.values() for t in c)
        weigh = lambda c: {t: n * (1 + math.log((1 + len(counted)) / (1 + df[t]))) for t, n in c.items()}
        known = [(name, weigh(terms(text))) for name, text in templates]
        out = {}
        for i, c in counted.items():
            own = weigh(c)
            size = math.sqrt(sum(w * w for w in own.values()))
            cosines = [(round(sum(w * own.get(t, 0) for t, w in k.items()) / size / math.sqrt(sum(w * w for w in k.values())), 9), name) for name, k in known]
            best = max(cosines)
            if best[0] >= least:
                out[i] = best
        return out

    says = f"{licenses.SPEAKS}|{licenses.GRANTS}"

    def spoken(text):
        lines = [x for x in text.split("\n") if re.search(says, x.lower())]
        return "\n".join(s for x in lines for s in regex.split(r"(?<=[.!?])\s+(?=\p{Lu})", x) if re.search(says, s.lower()))

    def joined(text):
        lines = []
        for line in text.split("\n"):
            line = re.sub(r"^[ \t]*(//+|/\*+|\*+(?!/)|#+|--+|;+|%+|<!--|\"{3}|'{3})!?[ \t]*", "", re.sub(r"((?<!\*)\*+/|-->)[ \t]*$", "", line))
            if lines and line and not line[0].isspace() and len(lines[-1][1].rstrip(" \t")) > 40 and lines[-1][1].rstrip(" \t")[-1] not in ".!?:;":
                lines[-1] = (f"{lines[-1][0].rstrip(' \t')} {line}", line)
            else:
                lines.append((line, line))
        return "\n".join(whole for whole, _ in lines)

    heads, wraps, wholes, is_file = {}, {}, {}, {}
    for i, path, text in files:
        speaks = re.search(licenses.SPEAKS, (text or "").lower()) is not None
        heads[i] = spoken(text) if speaks else None
        wraps[i] = spoken(joined(text)) if speaks else None
        wraps[i] = None if wraps[i] == heads[i] else wraps[i]
        wholes[i] = text if speaks else None
        name = (path or "").split("/")[-1]
        named = re.match(r"(?i)(un)?(licen[cs]e|copying|copyright|notice)s?([._-].*)?$", name)
        mostly = not re.match(r"[^.].*\.[A-Za-z][^.]*$", name) and len((heads[i] or "").split()) >= 0.5 * len((text or "").split())
        is_file[i] = speaks and bool(named or mostly)
    listed, texts = licenses.notices(), licenses.full_texts()
    short = [(name, spoken(joined(text))) for name, text in texts if len(text) <= 2000]
    by_line, by_paragraph, full = closest(heads, listed, 0.6), closest(wraps, listed + short, 0.6), closest(wholes, texts, 0.8)
    notices = {i: max(x[i] for x in (by_line, by_paragraph) if i in x) for i in by_line | by_paragraph}
    own = {i: full.get(i) or notices.get(i) for i, _, _ in files}
    speakers = {}
    for i, path, _ in files:
        if own[i] and (is_file[i] or i in full):
            directory = (path or "").rpartition("/")[0]
            speakers.setdefault(directory, []).append((-own[i][0], path, own[i][1]))
    want = {}
    for i, path, _ in files:
        directory = (path or "").rpartition("/")[0]
        above = [d for d in speakers if d == directory or directory.startswith(d + "/")]
        if own[i]:
            want[i] = (own[i][1], own[i][0], "file" if is_file[i] or i in full else "header", None)
        elif above:
            nearest = max(above, key=len)
            want[i] = (min(speakers[nearest])[2], None, "inherited", nearest)
        else:
            want[i] = (None, None, "none", None)
    return want


def test_license_scan_equals_brute_force(spark):
    draw = random.Random(9)
    full = dict(licenses.full_texts())
    notices = [t for _, t in licenses.TEMPLATES] + ["MIT License", "All rights reserved.", "Some licence or other.", "Copyright (c) 2020 A"]
    files = [(1, "b/LICENSE", "MIT License"), (2, "b/c/x.py", "y = 2"), (3, "c/x.py", "All rights reserved. Released under the MIT License by us."), (4, "c/y.py", "z"), (5, "d/COPYING.txt", full["GPL-2.0"]), (6, "d/e/f/g.c", "int x;"), (7, "long/a.txt", "word " * 60_000 + "\nReleased under the MIT License."), (8, "tie/LICENSE", "ISC License"), (9, "tie/LICENSE.old", "MIT License"), (10, "tie/z.py", "")]
    for i in range(120):
        folder = "/".join(draw.choices("pqr", k=draw.randint(1, 4)))
        name = draw.choice(["LICENSE", "a.py", "b", "NOTICE.md", "code.c", "README"])
        text = "\n".join(draw.choice(notices) if draw.random() < 0.3 else " ".join(draw.choices(["river", "mill", "sea", "x", "=", "1"], k=draw.randint(0, 12))) for _ in range(draw.randint(0, 6)))
        files.append((100 + i, draw.choice([None, f"{folder}/{i}-{name}", f"{folder}/{name}"]), draw.choice([text, text, None, full[draw.choice(sorted(full))]])))
    frame = spark.createDataFrame(files, "id long, path string, text string")
    got = {r["id"]: (r["license"], r["cosine"], r["evidence"], r["from_directory"]) for r in licenses.scan(frame).collect()}
    want = brute_scan(files)
    assert {i: (g[0], *g[2:]) for i, g in got.items()} == {i: (w[0], *w[2:]) for i, w in want.items()}
    assert all(g[1] == pytest.approx(want[i][1], abs=1e-8) if g[1] is not None else want[i][1] is None for i, g in got.items())
    assert got[1][2] == "file" and got[2][:1] == ("MIT",) and got[3][2] == "header" and got[4][2] == "none" and got[7][2] == "header"


def test_full_license_texts_speak_for_their_directory(spark):
    full = dict(licenses.full_texts())
    holder = "Copyright (c) 2026 Some Body\n\n"
    names = [n for n in full if n != "AGPL-3.0"]
    files = [(i, f"r{i}/LICENSE", holder + full[n]) for i, n in enumerate(names)]
    files += [(100 + i, f"r{i}/src/code.py", "x = 1") for i in range(len(names))]
    notice = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."
    files += [(200, "p/a.txt", "The river runs past the old mill and on to the sea. " * 9 + notice + " The mill has been shut for years." * 9)]
    files += [(201, "q/a.txt", "Some words on the licence of a work. " + "The river runs past the old mill. " * 40)]
    frame = spark.createDataFrame(files, "id long, path string, text string")
    got = {r["id"]: (r["license"], r["evidence"], r["from_directory"]) for r in licenses.scan(frame).collect()}
    for i, name in enumerate(names):
        assert got[i] == (name, "file", None) and got[100 + i] == (name, "inherited", f"r{i}")
    assert got[200] == ("Apache-2.0", "header", None) and got[201] == (None, "none", None)


def test_one_full_license_among_code(spark):
    files = [(1, "a/LICENSE", "Copyright (c) 2026 A\n\n" + dict(licenses.full_texts())["MIT"]), (2, "a/b/code.py", "x = 1")]
    got = {r["id"]: (r["license"], r["evidence"]) for r in licenses.scan(spark.createDataFrame(files, "id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "file"), 2: ("MIT", "inherited")}


# pipeline


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = ([r.asDict() for r in before.collect()], [r.asDict() for r in docs.collect()])
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    (raw, kept), (_, unique), (_, clean), (_, mixed), (_, tokens) = (seen[n] for n, _ in corpus_pipeline.STAGES)
    names, rated = rows_of_sql(quality.OP5_SQL, FOLDER)
    assert {r["doc_id"] for r in kept} == {r[names.index("doc_id")] for r in rated if r[names.index("kept")]} and len(rated) == len(raw)
    groups = brute_components({r["doc_id"]: r["text"] for r in kept})
    assert {r["doc_id"] for r in unique} == {c for _, c in groups.values()}
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in unique} and not any(base_spans(r["text"]) for r in clean)
    texts = {r["doc_id"]: r["text"] for r in clean}
    assert mixed and all(texts[r["doc_id"]] == r["text"] for r in mixed)
    assert sorted((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in mixed) == sorted((r["doc_id"], r["decoded_sha256"]) for r in tokens)
    assert json.dumps(corpus_pipeline.ORACLE_SQL) == "null"


def test_pipeline_on_hard_documents(spark, tmp_path):
    import corpus_pipeline

    words = "the river runs past an old mill and on to the sea as it has done for a thousand years or more so they say here".split()
    longer = [" ".join(words[i % 7 :] + [f"w{i}"] + words[: i % 7]) for i in range(12)]
    docs = documents(spark, [*TEXTS, *longer, longer[0].upper(), longer[1] + " write a.b@x.example.com"])
    for name in ("nth", "once", "copies", "row", "text_hash", "mix_id", "rid", "spans", "base"):
        docs = docs.withColumn(name, F.lit(f"keep {name}"))
    for part, frame in (("some", docs), ("none", docs.limit(0))):
        folder = str(tmp_path / part)
        frame.write.parquet(f"{folder}/documents.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, now, folder).write.parquet(f"{folder}/{number}")
            now = spark.read.parquet(f"{folder}/{number}")
            if number < 4:
                assert now.columns == docs.columns
                assert part == "none" or now.filter("nth = 'keep nth' and copies = 'keep copies' and row = 'keep row'").count() == now.count() > 0
        assert (now.count() > 0) == (part == "some")
