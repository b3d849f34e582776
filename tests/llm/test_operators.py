"""Each operator against a brute-force version over awkward rows: nulls, empty and long texts, ties, repeated rows, clashing
columns, empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from mensura.llm import boost, chat, jpeg, langid, lines, media, nearest, neardup, packing, pieces, pii, substring, wordhash
from mensura.llm.common import Scratch, release_scratch
from mensura.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def passages():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeéüñ") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, shared, long = say(120), say(60), say(9000)
    out = [base, base, base.upper(), base.replace(" ", "  \n"), base + " " + say(5), " ".join(base.split()[:-4] + say(4).split())]
    out += [say(40) + " " + shared + " " + say(10) for _ in range(4)] + [shared, shared + " " + shared]
    out += [None, "", " \t\n", "one", "one two three four", "one two three four", "a b c d e", "A B C D E", "x " * 300, "ab " * 100, long, long + " tail"]
    out += ["1 2 3 4", "!!! ... ---", "\x00 \x0b \x1c", "漢字 かな 😀 é", "w" * 5000, "line\nline\nline\nother\nline\nline\nline\nother\nend"]
    out += ["one\ntwo\nthree\nfour", "zero\none\ntwo\nthree\nfour", "\n\n\n\n", "a\nb"]
    out += ["Mail a.b+c@x-y.org, d@e.f.g_h@i.j or k@l; call +49 (170) 123-4567 now, +1 2", "ip 10.0.0.255 300.1.1.1 1.2.3.4.5 0001.002.03.4", "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 5500000000000004 and 0" * 2]
    return out


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "en" if i % 2 else "de", "s", 0) for i, t in enumerate(passages())]
    return out + [out[0], out[3], (None, "no id at all", None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"kept": F.lit(1), "id": F.lit(2), "score": F.lit("x"), "n": F.lit(0)})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_pieces(spark, docs, none, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = pieces.encode(docs.withColumn("decoded", F.lit(1))).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in rows)
    for r in got:
        want = sp.encode(r["text"] or "")
        assert r["piece_ids"] == want and r["decoded"] == sp.decode(want)
    assert pieces.encode(none).count() == 0
    small = pieces.PieceTable(public_tokenizers.path("piece_bpe_32k.model"), limit=5)  # emptied all the time
    rng = random.Random(1)
    for _ in range(2000):
        t = "".join(rng.choice(" \t▁abAé漢😀\x00<s>.") for _ in range(rng.randrange(30)))
        ids, text = small.encode(t)
        assert np.frombuffer(ids, "<i4").tolist() == sp.encode(t) and text == sp.decode(sp.encode(t))


def test_language(spark, none):
    rng = random.Random(5)
    vocab = {"aa": "the and ing tion with".split(), "bb": "der und ung keit mit".split()}
    text = lambda la: " ".join("".join(rng.choice(vocab[la]) for _ in range(rng.randint(1, 3))) for _ in range(30))
    train = [(text(la), la) for la in ("aa", "bb") for _ in range(60)]
    model = langid.fit(spark.createDataFrame([*train, (None, "aa"), ("x", None)], "text string, lang string"))
    assert model.langs == ["aa", "bb"]
    test = [(i, text(la), la) for i, la in enumerate(["aa", "bb"] * 40)]
    frame = spark.createDataFrame([*test, (None, None, None), (90, "12 !!", None), (91, "", None)], "doc_id long, text string, score string")
    got = langid.predict(frame, model).collect()
    assert len(got) == 83
    right = [r["lang_pred"] == dict((i, la) for i, _, la in test)[r["doc_id"]] for r in got if r["doc_id"] is not None and r["doc_id"] < 90]
    assert sum(right) / len(right) > 0.97
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in got if r["doc_id"] is None or r["doc_id"] >= 90)
    for r in got[:20]:  # word by word
        own = langid.words(r["text"] or "")
        if own:
            total = sum(model.score([w])[0] for w in own)
            assert model.langs[int(np.argmax(total))] == r["lang_pred"] and 0.5 <= r["score"] <= 1
    # an unseen word falls back to its longest known n-grams
    word, padded = "theund", "\x02theund\x03"
    if word not in model.words:
        found = [next(g for n in range(min(4, e), 0, -1) if (g := padded[e - n : e]) in model.grams) for e in range(2, len(padded) + 1)]
        logs = []
        for g in found:
            c = np.array([v for k, v in model.grams.items() if len(k) == len(g)]) + langid.SMOOTH
            logs.append(np.log((np.array(model.grams[g]) + langid.SMOOTH) / c.sum(0)))
        assert np.allclose(model.score([word])[0], np.mean(logs, 0))
    # numerals are no letters; columns that clash are replaced
    odd = spark.createDataFrame([(1, "½ ² ① Ⅷ", "x"), (2, None, "x")], "doc_id long, text string, lang_pred string")
    assert [(r["lang_pred"], r["score"]) for r in langid.predict(odd, model).orderBy("doc_id").collect()] == [("und", 0.0)] * 2
    assert langid.words("½a² bⅧc d1e ÀÉ") == ["a", "b", "c", "d", "e", "àé"]
    # a model and its predictions by hand
    by_word, by_gram = Counter(), Counter()
    for t, la in train:
        for w in re.findall("[a-z]+", t):
            by_word[w, la] += 1
            for n in range(1, 5):
                by_gram.update((f"\x02{w}\x03"[i : i + n], la) for i in range(len(w) + 3 - n))
    assert {w: c for w, c in model.words.items()} == {w: [by_word[w, la] for la in model.langs] for w in {w for w, _ in by_word}}
    assert {g: c for g, c in model.grams.items()} == {g: [by_gram[g, la] for la in model.langs] for g in {g for g, _ in by_gram}}

    def log(counts, key, same):
        keys = {k for k, _ in counts if same(k)}
        return np.array([np.log((counts[key, la] + 0.5) / (sum(counts[k, la] for k in keys) + 0.5 * len(keys))) for la in model.langs])

    for r in [r for r in got if r["doc_id"] is not None and r["doc_id"] < 12]:
        total = np.zeros(2)
        for w in r["text"].split():
            if w in model.words:
                total += log(by_word, w, lambda k: True)
                continue
            p, logs = f"\x02{w}\x03", []
            for end in range(2, len(p) + 1):
                g = next((p[end - n : end] for n in range(min(4, end), 0, -1) if p[end - n : end] in model.grams), None)
                if g:
                    logs.append(log(by_gram, g, lambda k, g=g: len(k) == len(g)))
            total += np.mean(logs, 0)
        best = int(np.argmax(total))
        assert r["lang_pred"] == model.langs[best] and abs(r["score"] - 1 / np.exp(total - total[best]).sum()) < 1e-9
    empty = langid.fit(none)
    assert [r["lang_pred"] for r in langid.predict(frame.limit(2), empty).collect()] == ["und", "und"] and langid.predict(none, model).count() == 0


def test_media(spark, docs, none, rows):
    raw = docs.withColumn("raw", F.coalesce("text", F.lit("")).cast("binary")).withColumn("payload", F.lit(1))
    got = media.load(media.store(raw, "raw")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = media.padded((r["text"] or "").encode())
        assert bytes(r["payload"]) == want and len(want) % 576 == 0 and want
        assert len(r["rgb"]) == r["height"] * r["width"] * 3 and r["feature"].startswith(f"{r['width']}x{r['height']};")
    assert len({r["text"] or "" for r in got}) == len({(r["text"] or "", bytes(r["media"]), r["feature"]) for r in got})
    assert media.load(media.store(none.select(F.col("text").cast("binary").alias("raw")), "raw")).count() == 0
    assert media.load(spark.createDataFrame([(None,)], "media binary")).first()["payload"] is None


def slow_dct(coef):
    """Samples of one block from zigzag coefficients, by the definition."""
    out = np.zeros((8, 8))
    for k, z in enumerate(jpeg.ZIGZAG):
        v, u = divmod(int(z), 8)
        y, x = np.mgrid[0:8, 0:8]
        c = (np.sqrt(1 / 8) if u == 0 else 0.5) * (np.sqrt(1 / 8) if v == 0 else 0.5)
        out += c * coef[k] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16)
    return out + 128


def test_jpeg_scans_and_transform():
    rng = np.random.default_rng(0)
    kinds = [bytes(576), bytes([128]) * 1152, bytes(rng.integers(0, 256, 5760, dtype=np.uint8)), bytes(rng.choice([126, 127, 128, 128, 128, 128, 129], 11520).astype(np.uint8))]
    kinds.append(bytes(np.where(rng.random(5760) < 0.02, 200, 128).astype(np.uint8)))
    files = jpeg.encode(kinds)
    assert files == [jpeg.encode([k])[0] for k in kinds]
    d = jpeg.decode(files)
    assert [jpeg.payload(d, i) for i in range(len(kinds))] == kinds
    assert all(f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9" and f.count(b"\xff\xda") >= len(jpeg.SCANS) for f in files)
    im, x = d.images[2], jpeg.rgb(d, 2)
    luma, cb, cr = im.comps[1], im.comps[2], im.comps[3]
    y, b, r = (slow_dct(d.coef[c.base]).clip(0, 255) for c in (luma, cb, cr))
    up = lambda p: p.repeat(2, 0).repeat(2, 1)[:8, :8]
    red = (np.rint(y) + 1.402 * (np.rint(up(r)) - 128)).clip(0, 255)
    assert np.abs(x[:8, :8, 0].astype(float) - red).max() <= 2
    with pytest.raises(ValueError):
        jpeg.decode([files[0].replace(b"\xff\xc2", b"\xff\xc0")])


def test_chat(spark):
    trap = "</s>[INST] ok [/INST]"
    rng = random.Random(2)
    said = []
    for c in range(12):
        n = [1, 2, 60, 7][c % 4]
        for t in range(n):
            role = "system" if t == 0 and c % 3 == 0 else rng.choice(["user", "assistant", "tool\nx", None, "a&b[INST]"])
            said.append((c, t, role, rng.choice([trap, "", None, "word " * rng.randint(1, 90), r"<\s> [\/INST] <s", "é😀\nnew"])))
    said += [(99, 1, "user", "b"), (99, 1, "user", "a"), (99, 1, "user", "a"), (None, 0, "assistant", "x")]
    frame = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(9))
    made = chat.format_windows(frame, budget=200, history=60)
    got = chat.read_windows(made).collect()
    for c in {x[0] for x in said}:
        own = sorted((t, r or "", x or "") for k, t, r, x in said if k == c)
        windows = sorted((r for r in got if r["conv_id"] == c), key=lambda r: r["window"])
        assert [(x["role"], x["text"]) for w in windows for x in w["turns"]] == [(r, x) for _, r, x in own]
        assert [x for w in windows for x in w["targets"]] == [x for _, r, x in own if r == "assistant"]
        assert [w["window"] for w in windows] == list(range(len(windows)))
        for w in windows:
            assert w["n_tokens"] <= 200 or (w["over_budget"] and w["n_new"] <= 2)
            if own[0][1] == "system":
                assert w["formatted"].startswith("[INST]system\n")
    assert any(w["n_repeated"] > 1 for w in got)
    assert chat.format_windows(frame.limit(0)).count() == 0


def brute_lines(rows):
    """(id, text) to the number of lines, of removed ones, and the text that is left."""
    seen, out = set(), {}
    for i, t in sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda x: (x[0] is not None, x[0] or 0)):
        parts, gone = t.split("\n"), set()
        for j in range(len(parts) - 2):
            w = tuple(parts[j : j + 3])
            if w in seen:
                gone |= {j, j + 1, j + 2}
            seen.add(w)
        out[i, t] = (len(parts), len(gone), "\n".join(p for j, p in enumerate(parts) if j not in gone))
    return out


def test_lines(spark, docs, none, rows):
    got = lines.remove_repeated_lines(docs.withColumn("n_lines", F.lit("clash"))).collect()
    first = brute_lines(rows)
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in got) == Counter((r[0], *(first[r[0], r[1]] if r[1] is not None else (0, 0, None))) for r in rows)
    assert any(r["n_removed"] for r in got) and lines.remove_repeated_lines(none).count() == 0


@pytest.mark.parametrize("hot", [2048, 2])
def test_substring(spark, docs, none, rows, hot, monkeypatch):
    monkeypatch.setattr(substring, "HOT", hot)
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    n = Counter(tuple(w[j : j + 35]) for w in words for j in range(len(w) - 34))
    want = Counter()
    for r, w in zip(rows, words, strict=True):
        gone = {k for j in range(len(w) - 34) if n[tuple(w[j : j + 35])] > 1 for k in range(j, j + 35)}
        want[r[0], len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    got = substring.remove_repeats(docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == want
    assert substring.remove_repeats(none).count() == 0
    release_scratch()


def test_substring_batches_from_day_to_day(spark, docs, rows, tmp_path):
    """Three batches through an index that is opened anew each time give what one run gives."""
    want = Counter((r["doc_id"], r["n_removed"], r["kept"]) for r in substring.remove_repeats(docs, batches=1).collect())
    keyed = substring._keyed(docs, "doc_id", "text").withColumn("day", F.pmod(F.xxhash64("kid", "kt"), F.lit(4)))
    root = f"file://{tmp_path}/index"
    for day in range(4):
        index = substring.FingerprintIndex(spark, root)
        assert len(index.tables["run"]) <= substring.FANOUT
        index.append(keyed.where(F.col("day") == day).drop("day"))
        index.close()
    index = substring.FingerprintIndex(spark, root)
    assert Counter((r["doc_id"], r["n_removed"], r["kept"]) for r in substring.clean(docs, index).collect()) == want
    # documents that come later are judged against all that came before
    late = spark.createDataFrame([(9001, next(r[1] for r in rows if r[1] and len(r[1]) > 20_000)[:3000])], "doc_id long, text string")
    (row,) = substring.remove_repeats(late, batches=1, index=index).collect()
    assert row["n_removed"] > 300
    index.close()
    release_scratch()


def test_packing(spark, docs, none, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack(docs).collect()
    of: dict = {}
    for r in got:
        of.setdefault(r["doc_id"], []).append(r)
    for i in {r[0] for r in rows}:
        texts = [r[1] or "" for r in rows if r[0] == i]
        ids = [tok.encode(t, add_special_tokens=False).ids + [1] for t in texts]
        want = Counter()
        for x in ids:
            at = 0
            for size, _ in packing.cut(len(x)):
                want[at, size, zlib.crc32(np.array(x[at : at + size], "<u4").tobytes()), len(x)] += 1
                at += size
            assert at == len(x)
        assert Counter((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in of[i]) == want
    bins: dict = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack(none).count() == 0
    rng, worker, total = random.Random(4), packing.Bins(0), 0
    for i in range(3000):
        n = rng.randint(1, 3000)
        total += n
        at = 0
        for size, m in packing.cut(n):
            assert size * m <= 2048
            worker.add(m, (i, at, size, 0, n))
            at += size
    worker.finish()
    assert worker.next * 2048 < 1.02 * total
    for _ in range(3000):  # tokens of words apart are those of the text
        t = "".join(rng.choice([" ", "\t", "\x85", "a", "B", "é", "É", "́", "Σ", "'s", "漢", "1", "<|endoftext|>", "<|", "!", "\x00", "º", "ß"]) for _ in range(rng.randrange(12)))
        assert np.frombuffer(packing.token_table(public_tokenizers.path("word_bpe_49k.json")).encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_packing_with_another_tokenizer(spark, tmp_path):
    """A tokenizer whose words aren't known to be apart gets whole texts; clashing columns are not read."""
    import json

    from tokenizers import Tokenizer

    made = json.load(open(public_tokenizers.path("word_bpe_49k.json")))
    assert packing.words_apart(public_tokenizers.path("word_bpe_49k.json"))
    made["normalizer"]["normalizers"].pop()  # case stays
    path = str(tmp_path / "other.json")
    json.dump(made, open(path, "w"))
    assert not packing.words_apart(path)
    texts = ["Some Words IN Capitals", "one  two\n", ""]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, start long, offset long")
    tok = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in packing.pack(frame, model=path).collect()}
    for i, t in enumerate(texts):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        assert (got[i]["doc_tokens"], got[i]["ids_crc32"], got[i]["start"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), 0)


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in hit.split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]


def pii_texts():
    rng = random.Random(8)
    noise = ["".join(rng.choice(["a", "@", ".", "1", "25", " ", "-", "+", "(", "_", "é", "😀", "4111 1111 1111 1111", "+1 202 555 0100", "x@y.z"]) for _ in range(40)) for _ in range(300)]
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    say = lambda n: " ".join(word() for _ in range(n))
    digit = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    own = []
    for _ in range(150):
        made = rng.choice([f"{word()}.{word()}@{word()}.com", f"{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}", "4111 1111 1111 1111", "5500000000000004", f"+1 ({digit(3)}) {digit(3)}-{digit(4)}"])
        own.append(f"{say(6)} {made} {say(6)} version 4.0 in {rng.randint(1990, 2024)} {say(3)} 3,1415 {say(2)} page {digit(2)}")
    return noise + own


def test_pii(spark, docs, none, rows):
    noise = pii_texts()
    frame = spark.createDataFrame([*((r[0], r[1]) for r in rows), *((1000 + i, t) for i, t in enumerate(noise))], "doc_id long, text string").withColumn("pii_base", F.lit(1))
    finder = pii.fit(frame)
    got = pii.find(frame, finder).collect()
    assert len(got) == len(rows) + len(noise)
    for r in got:
        t = r["text"] or ""
        want = sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, t) if passes(k, m[0]))
        assert [(x["start"], x["rank"], x["end"], x["kind"]) for x in r["pii_base"]] == want
        spans = [(x["start"], x["end"]) for x in r["pii_spans"]]
        assert all(t[x["start"] : x["end"]] == x["hit"] for x in r["pii_spans"]) and {(a, b) for a, _, b, _ in want} <= set(spans)
        added = [x for x in r["pii_spans"] if (x["start"], x["rank"], x["end"], x["kind"]) not in want]
        every = sorted([(a, b) for a, _, b, _ in want] + [(x["start"], x["end"]) for x in added])
        for x in added:  # an added span overlaps no other one
            assert sum(a < x["end"] and x["start"] < b for a, b in every) == 1
    clean = pii.redact(pii.find(frame, finder)).collect()
    want = Counter()
    for r in got:
        out, at, t = "", 0, r["text"] or ""
        for x in r["pii_spans"]:
            if x["start"] >= at:
                out += t[at : x["start"]] + f"[{x['kind'].upper()}]"
            at = max(at, x["end"])
        want[r["doc_id"], r["text"] and out + t[at:]] += 1
    assert Counter((r["doc_id"], r["text"]) for r in clean) == want
    assert pii.find(none, pii.fit(none)).count() == 0
    many = " ".join(f"x{i}@y.com {'é' * (i % 40)}" for i in range(3000))  # text and spans both long
    big = spark.createDataFrame([(1, "a" * 200_000 + " " + "1" * 200_000 + " a@b" + ".c" * 50_000), (2, many)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.redact(pii.find(big, pii.Finder())).collect()}
    assert len(found[1]["pii_base"]) == 1 and len(found[2]["pii_base"]) == 3000
    assert found[2]["text"] == " ".join(f"[EMAIL] {'é' * (i % 40)}" for i in range(3000))


def test_pii_finds_what_the_patterns_miss(spark):
    """Spans written another way are added, what only looks alike is refused."""
    finder = pii.fit(spark.createDataFrame([(t,) for t in pii_texts()[300:]], "text string"))
    assert set(finder.held) == set(pii.KINDS) and all(n and precision >= 0.9 and recall >= 0.6 for n, precision, recall in finder.held.values()), finder.held
    loose = {
        "reach anna.lee (at) fjord [dot] com before noon": "anna.lee (at) fjord [dot] com", "reach anna.lee[at]fjord[dot]com before noon": "anna.lee[at]fjord[dot]com",
        "a card of 4111 1111 1111 1112 was shown": "4111 1111 1111 1112", "the number (202) 555-0147 was called": "(202) 555-0147", "from host 192,168,21,255 it came": "192,168,21,255",
    }
    refused = ["licensed under CC BY-NC 4.0 as it is", "in the years 1990 to 2024 it was", "about 3,1415 of them", "on 2024-05-17 they met", "look @ that", "pages 12, 13 and 14", "it cost 1,200 or 12.50"]
    frame = spark.createDataFrame([(t,) for t in [*loose, *refused]], "text string")
    got = {r["text"]: [x["hit"] for x in r["pii_spans"]] for r in pii.find(frame, finder).collect()}
    assert {t: got[t] for t in loose} == {t: [h] for t, h in loose.items()}
    assert all(not got[t] for t in refused), {t: got[t] for t in refused}


def test_boosting(spark):
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(int)
    held = np.arange(3000) % 3 == 0
    m = boost.fit(x, y, held)
    p = m.probability(x[held])
    # sixteen cuts for a feature leave a few rows at the borders on the wrong side
    assert ((p > 0.5) == y[held]).mean() > 0.9
    some = spark.createDataFrame([(v.tolist(),) for v in x[held][:50]], "f array<double>").select(m.column(F.col("f")).alias("p")).collect()
    assert np.allclose([r["p"] for r in some], p[:50])


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (rows[i][0] == rows[j][0] and a and b) or (a and b and 100 * len(a & b) >= 75 * len(a | b)):
                if rows[i][0] is not None and rows[j][0] is not None:
                    parent[max(root(i), root(j))] = min(root(i), root(j))
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return Counter((d, len(sets[i]), None if d is None else least[root(i)]) for i, (d, _) in enumerate(rows))


def test_near_duplicates(spark, docs, none, rows):
    rng = random.Random(6)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    copies = []
    for i in range(40):  # a group around one text that few are near to but all are linked by
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        copies.append((500 + i, " ".join(w)))
    own = [(r[0], r[1]) for r in rows] + copies + [(5, copies[0][1])]  # one id with two texts
    frame = spark.createDataFrame(own, "doc_id long, text string").withColumns({"kept": F.lit(1), "id": F.lit(2), "digest": F.lit(3)}).repartition(3)
    got = neardup.near_duplicates(frame).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(own)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)
    assert neardup.near_duplicates(none).count() == 0
    release_scratch()


def thue_morse(n):
    """A word over two letters and the same with the letters swapped; hashes that are polynomials of the letters collide."""
    w = [0]
    while len(w) < n:
        w += [1 - x for x in w]
    return "".join("ab"[x] for x in w), "".join("ba"[x] for x in w)


def test_words_that_polynomials_confuse(spark):
    rows = []
    for k, n in enumerate((1024, 64, 32)):
        x, y = thue_morse(n)
        tail = " ".join(f"t{n}.{i}" for i in range(34))
        rows += [(10 * k + i, t) for i, t in enumerate([x, y, f"{x} {tail}", f"{y} {tail}"])]
        mixed = [" ".join(w) for w in (x, y)]  # as words, too
        a, b = (next(neardup.shingle_sets([t.encode()])) for t in mixed)
        words = [t.split() for t in mixed]
        sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
        assert a.shape[1] == len(sets[0]) and len(set(zip(*a.tolist(), strict=True)) & set(zip(*b.tolist(), strict=True))) == len(sets[0] & sets[1])
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame).collect()}
    assert all(got[i] == i and got[i + 1] == i + 1 and got[i + 2] == got[i + 3] for i in (0, 10, 20))
    assert all(r["n_removed"] == 0 for r in substring.remove_repeats(frame, batches=1).collect())


def test_word_digests_differ():
    rng = random.Random(1)
    words = {bytes(rng.randrange(1, 4) for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200]))).translate(bytes.maketrans(b"\1\2\3", b"\0ab")) for _ in range(20_000)}
    own = sorted(words)
    lanes, counts = wordhash.words(own)
    assert counts.tolist() == [1] * len(own)
    assert len(set(lanes[0].tolist())) == len(set(lanes[1].tolist())) == len(own)
    again, _ = wordhash.words([b" ".join(own)])
    assert (again == lanes).all()


def test_components(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(60)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)] + [(7, 7), (None, 1)]
    parent = {x: x for e in links for x in e if x is not None}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()
    assert {r["node"]: r["root"] for r in got} == {x: root(x) for e in links for x in e if x is not None and e[0] != e[1] and None not in e}
    assert len(got) == len({r["node"] for r in got})


def test_sequential_test_misses_little():
    rng = np.random.default_rng(3)
    rules = neardup.thresholds()
    hits = (rng.random((200_000, neardup.BANDS * neardup.ROWS)) < 0.75).cumsum(1)
    lost = np.zeros(len(hits), bool)
    for n, least in rules:
        lost |= hits[:, n - 1] < least
    assert lost.mean() < 1e-4 and rules[-1][1] > 100


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 24)).astype(np.float32)
    x[100:220] = x[100]  # a third is one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (701, [0.0] * 24), (702, [float("nan")] * 24), (703, [1.0] * 5), (704, [None] * 24), (None, x[0].tolist()), (5, x[5].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"rank": F.lit(1), "label": F.lit(0)})
    rough = nearest.search(frame, frame.where("vec_id % 100 = 0")).collect()
    got = nearest.search(frame, frame.where("vec_id % 100 = 0"), target=1.0, margin=float("inf")).collect()
    assert len(rough) == len(got) and len({(r["query_id"], r["vec_id"]) for r in rough} & {(r["query_id"], r["vec_id"]) for r in got}) >= 0.9 * len(got)
    for q in range(0, 600, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(600), d))[:10]
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in own] == want.tolist() and np.allclose([r["score"] for r in own], d[want], atol=1e-12)
    assert {r["query_id"] for r in got} == set(range(0, 600, 100))
    few = frame.where("vec_id < 4")
    assert nearest.search(few, few).groupBy("query_id").count().where("count = 3").count() == 4
    assert nearest.search(frame.limit(0), frame.limit(0)).count() == 0


@pytest.mark.parametrize("spread", [0.2, 1.0])
def test_nearest_recall_with_lists(spark, spread, monkeypatch):
    """Recall against brute force through the whole search, with many lists that are dealt into parts."""
    monkeypatch.setattr(nearest, "PART", 100)
    monkeypatch.setattr(nearest, "ASKED", 20)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 32))[rng.integers(0, 60, 6000)] + spread * rng.standard_normal((6000, 32))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = nearest.search(frame, frame.where("vec_id % 100 = 0")).collect()
    hits = 0
    for q in range(0, 6000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and all(abs(r["score"] - d[r["vec_id"]]) < 1e-9 for r in own)
        hits += len({r["vec_id"] for r in own} & set(np.argsort(d)[:10].tolist()))
    assert hits / 600 >= 0.9
    lists = nearest.fit(x[:3000], len(x))
    assert len(lists.centres) > 50 and (spread > 0.5 or lists.probed < len(lists.centres) / 4)


def test_scan_drops_what_is_far():
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((2000, 64)), rng.standard_normal((5, 64))
    d = ((x[None] - q[:, None]) ** 2).sum(2)
    bounds = np.sort(d, 1)[:, 9]
    at, of, found = nearest.scan([x[:, a:b] for a, b in nearest.cuts(64)], q, bounds, 10)
    assert np.allclose(found, d[at, of]) and (found <= bounds[at] * (1 + 1e-6)).all() and len(at) >= 45
    at, of, _ = nearest.scan([x[:, a:b] for a, b in nearest.cuts(64)], q, np.full(5, np.inf), 10)
    assert all(len(set(of[at == i]) & set(np.argsort(d[i])[:10])) >= 9 for i in range(5))


def test_pii_learns_from_all_texts(spark):
    """Every span of every distinct text counts, in whichever of a great number of documents it is; copies count once."""
    texts = [f"call +1 202 555 {i:04d} or write to a{i}@b.com, p{i}" for i in range(6000)]
    frame = spark.createDataFrame([(t,) for t in [*texts, *texts[:500], None, "", "plain"]], "text string")
    finder = pii.fit(frame)
    held = [r[0] for r in frame.distinct().where("text like 'call%' and shiftrightunsigned(xxhash64(text), 11) % 10 < 3").collect()]
    assert finder.held["email"][0] == 6 * len(held) and len(held) > 1500  # each as it is and written in five other ways


def test_boosting_by_weights():
    """A row that stands for several examples counts as these do."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 6, (400, 3)).astype(float)
    y, held, n = (x[:, 0] + x[:, 1] > 5).astype(int), rng.random(400) < 0.3, rng.integers(1, 5, 400)
    whole = [np.repeat(v, n, 0) for v in (x, y, held)]
    assert np.allclose(boost.fit(x, y, held, n).probability(x), boost.fit(*whole).probability(x))
