"""The training-data operators against brute force, round trips and hand-made cases."""

import base64
import binascii
import gzip
import hashlib
import io
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from spotweave.llm import chat_format, common, decontamination, jaccard_join, language_id, license_scan, line_dedup, nearest, sentence_pieces, token_counts, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\n", "!!! ... 123", "a", "two words", "é ñ ß 日本", "x" * 30000, "word " * 8000, "<|endoftext|> a", "▁ mark", "tab\there \x00 nul"]


def odd_docs(spark, extra="n_tokens string"):
    rows = [(i, t, None if i % 3 else "en", None if i % 4 else f"s{i % 5}", "clash") for i, t in enumerate(ODD)]
    rows += [rows[5], (None, "no id at all", "en", "s1", "clash"), (None, None, None, None, None)]
    return spark.createDataFrame(rows, f"{DOCS}, {extra}")


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


# --- language identification


def test_language_held_out_accuracy_and_rejection(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    model = language_id.fit(docs.where(~held))
    found = language_id.identify(docs.where(held), model).toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.95
    assert found.score.between(0, 1).all()
    # brute force: the nearest centroid of each vector, one at a time
    for row in found.head(20).itertuples():
        v = language_id.vector(language_id.counts(row.text), model.idf)
        assert row.lang_pred == model.names[int(np.argmax(model.centroids @ v))]
    odd = {r.doc_id: r for r in language_id.identify(odd_docs(spark, "score string"), model).collect()}
    for i in (0, 1, 2, 3, 4):
        assert (odd[i].lang_pred, odd[i].score, odd[i].rejected) == ("und", 0.0, True)
    assert odd[8].rejected and odd[8].lang_pred in model.names  # thirty thousand times one letter


def test_language_rejects_long_texts_of_none(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    model = language_id.fit(docs.where(~held))
    clean = [r for r in model.predict([r.text for r in docs.where(held).collect()]) if r[3]]
    assert np.mean([r[2] for r in clean]) <= 0.02
    rng = random.Random(1)
    unlearned = [
        "nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita ah quanto a dir qual era è cosa dura questa selva selvaggia e aspra e forte che nel pensier rinova la paura",
        "vaka vanha väinämöinen itse tuon sanoiksi virkki mieleni minun tekevi aivoni ajattelevi lähteäni laulamahan saa'ani sanelemahan sukuvirttä suoltamahan lajivirttä laulamahan",
        "litwo ojczyzno moja ty jesteś jak zdrowie ile cię trzeba cenić ten tylko się dowie kto cię stracił dziś piękność twą w całej ozdobie",
    ]
    letters = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(2000)]
    texts = [" ".join(rng.choices(words, k=n)) for words in (letters, *map(str.split, unlearned)) for n in (60, 250, 800)]
    assert all(rejected for _, _, rejected, _ in model.predict(texts))
    # classes keep radii of their own; those without texts follow from the next ones
    assert language_id.by_length([0.2, 0.4, 0.6, 0.5, 0.9]) == [0.2, 0.4, 0.5, 0.5, 0.9]
    assert language_id.by_length([None, 0.4, None, 0.8, None]) == [0.2, 0.4, 0.4, 0.8, 0.8]


def test_language_without_rows_or_labels(spark):
    model = language_id.fit(no_docs(spark))
    assert language_id.identify(no_docs(spark), model).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd_docs(spark), model).collect()} == {"und"}


# --- token counts


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    docs = odd_docs(spark).select("doc_id", "text", "n_tokens").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit("x").alias("n_tokens")))
    tokenizer = Tokenizer.from_file(BPE)
    for r in token_counts.count_tokens(docs, BPE).collect():
        assert r.n_tokens == len(tokenizer.encode(r.text or "", add_special_tokens=False))
        assert r.n_bytes == len((r.text or "").encode())
    assert token_counts.count_tokens(no_docs(spark), BPE).count() == 0


def test_token_parts_are_safe_anywhere():
    counter, rng = token_counts.Counter(BPE), random.Random(1)
    letters = ["a", "Z", "é", "'s", "'", " ", "  ", "\n", "\t", ".", ",", "7", "日", " ", "\x1c", "<|endoftext|>", "-", "!"]
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(3000)]
    assert counter.counts(texts) == [len(e) for e in counter.tokenizer.encode_batch(texts, add_special_tokens=False)]


# --- WARC


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


def test_warc_round_trip_and_revisits(spark, tmp_path):
    rows = [(3, "http://a/1", "same", "c"), (1, "http://a/2", "same", "c"), (2, None, "other é", "c"), (4, "u", None, None), (5, "u", "", None), (6, "u v", "z" * 700000, None), (None, "u", "same", None), (1, "http://a/2", "same", "c")]
    records = warc.decide_types(pages(spark, rows))
    folder = str(tmp_path / "warc")
    manifest = warc.write_archives(records, folder, archive_bytes=200)
    found = warc.read_archives(spark, manifest).collect()
    assert sum(r.records for r in manifest.collect()) == len(rows) == len(found)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = sorted([("revisit", 3, 1, 4, digest("same")), ("response", 1, None, 4, digest("same")), ("response", 1, None, 4, digest("same")), ("response", 2, None, 8, digest("other é")), ("response", 4, None, 0, digest("")), ("revisit", 5, 4, 0, digest("")), ("response", 6, None, 700000, digest("z" * 700000)), ("revisit", None, 1, 4, digest("same"))], key=repr)
    assert sorted([(r.record_type, r.record_id, r.refers_to, r.payload_bytes, r.payload_digest) for r in found], key=repr) == want
    assert {r.record_id: bytes(r.payload).decode() for r in found if r.record_type == "response"}[2] == "other é"
    # each record is a gzip member of its own that any reader opens
    name = manifest.first().archive
    assert gzip.decompress(open(name, "rb").read()).startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_warc_min_bytes_empty_and_damage(spark, tmp_path):
    types = warc.decide_types(pages(spark, [(1, "u", "ab", None), (2, "u", "ab", None)]), min_bytes=3).collect()
    assert [r.refers_to for r in types] == [None, None]
    manifest = warc.write_archives(warc.decide_types(pages(spark, [])))
    assert warc.read_archives(spark, manifest).count() == 0
    member = warc.record(1, "http://x", b"hello", None) + warc.record(2, "http://x", b"world" * 100000, None)
    assert [r[4] for r in warc.read_records(io.BytesIO(member))] == [5, 500000]
    bad = gzip.compress(gzip.decompress(warc.record(1, "u", b"hello", None)).replace(b"hello", b"jello"))
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records(io.BytesIO(bad)))
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.read_records(io.BytesIO(member[:-9])))
    assert binascii.crc32(b"") == 0


# --- SentencePiece


def test_pieces_equal_the_library_and_decode_back(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = odd_docs(spark, "ids string").select("doc_id", "text", "ids").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit("x").alias("ids")))
    for r in sentence_pieces.encode_and_decode(docs, PIECES).collect():
        if r.text is None:
            assert r.ids is None and r.decoded is None
        else:
            assert r.ids == model.encode(r.text)
            assert r.decoded == r.text.replace("▁", " ") == model.decode(r.ids)
    both = sentence_pieces.decode(sentence_pieces.encode(docs.drop("ids"), PIECES), PIECES).where("decoded is not null")
    assert both.where("decoded <> replace(text, '▁', ' ')").count() == 0
    assert sentence_pieces.encode(no_docs(spark), PIECES).count() == 0


def test_shared_prefixes_change_nothing():
    pieces, alone = sentence_pieces.Pieces(PIECES), sentence_pieces.Pieces(PIECES)
    rng = random.Random(3)
    words = sorted({"▁" + "".join(rng.choices("abcdeinorst", k=rng.randint(1, 14))) for _ in range(400)})
    pieces.encode_sorted(words)
    for w in words:
        alone.encode_sorted([w])
        assert pieces.known[w] == alone.known[w] == [alone.ids[p] for p in alone.merged(w)]


def test_unigram_search_finds_the_best_segmentation():
    pieces = sentence_pieces.Pieces(PIECES, "unigram")
    pieces.scores = {p: -abs(hash(p) % 97) - 1.0 for p in ("a", "b", "c", "ab", "bc", "abc", "ca", "▁", "▁a")}
    pieces.ids = {p: i for i, p in enumerate(pieces.scores)}
    pieces.tails, pieces.lengths = pieces._tails(), {}

    def best(word):
        return max((pieces.scores[word[:n]] + (best(word[n:]) if word[n:] else 0.0) for n in range(1, len(word) + 1) if word[:n] in pieces.scores), default=float("-inf"))

    names = list(pieces.scores)
    for word in ("▁abcabca", "▁aabbcc", "▁cabcab"):
        pieces.encode_sorted([word])
        assert sum(pieces.scores[names[i]] for i in pieces.known[word]) == best(word)


# --- chat formatting


def test_preferences_share_the_prompt_once(spark):
    turn = lambda r, t: {"role": r, "text": t}
    head = [turn("system", "s"), turn("user", "q")]
    rows = [(1, head + [turn("assistant", "good")], head + [turn("assistant", "bad"), turn("user", "no"), turn("assistant", "so")], "c"), (2, head, head, "c"), (3, [turn("user", "x")], [], "c"), (4, [turn("user", "x")], [turn("assistant", "x")], "c")]
    pairs = spark.createDataFrame(rows, "conv_id long, chosen array<struct<role string, text string>>, rejected array<struct<role string, text string>>, prompt string")
    got = {r.conv_id: r for r in chat_format.format_preferences(pairs).collect()}
    show = lambda t: f"<|im_start|>{t['role']}\n{t['text']}<|im_end|>\n"
    for i, chosen, rejected, _ in rows:
        n = len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(chosen, rejected, strict=False))))
        r = got[i]
        assert r.n_prompt_turns == n and r.prompt == "".join(map(show, chosen[:n]))
        for side, text, mask in ((chosen, r.chosen_text, r.chosen_mask), (rejected, r.rejected_text, r.rejected_mask)):
            assert text == "".join(map(show, side[n:]))
            assert [text[int(a) : int(b)] for a, b in (m.split("-") for m in mask)] == [t["text"] + "<|im_end|>" for t in side[n:] if t["role"] == "assistant"]


def test_preference_pairs_of_odd_tables(spark):
    kind = "conv_id long, turn long, role string, text string"
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "a0"), (0, 1, "assistant", "a0"), (0, 2, "user", "tail"), (1, 0, "assistant", None), (2, 0, "user", "alone"), (None, 0, "assistant", "x"), (4, None, None, None), (4, 1, "assistant", "a4")]
    got = {r.conv_id: r for r in chat_format.preference_pairs(spark.createDataFrame(rows, kind)).collect()}
    assert set(got) == {0, 1, 4}
    assert [t.text for t in got[0].chosen] == ["hi", "a0"] and [t.text for t in got[0].rejected] == ["hi", ""]
    assert [t.text for t in got[1].rejected] == ["a0"] and got[4].rejected[-1].text == ""
    assert chat_format.preference_pairs(spark.createDataFrame([], kind)).count() == 0


# --- line dedup


def test_lines_against_brute_force(spark):
    rng = random.Random(5)
    lines = [f"line {i}" for i in range(30)] + [""]
    spread = {line: rng.randint(1, 14) for line in lines}
    rows = []
    for i in range(400):
        site = rng.randint(1, 14)
        rows.append((i, "\n".join(x for x in rng.choices(lines, k=8) if spread[x] >= site or x == ""), "en", f"site{site}", "c"))
    rows += [(900, None, None, "site1", "c"), (901, "", None, None, "c"), (902, "line 0\nonly mine", None, None, "c"), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, f"{DOCS}, n_lines string")
    sites = {}
    for _, t, _, s, _ in rows:
        for line in (t or "").split("\n"):
            if line and s:
                sites.setdefault(line, set()).add(s)
    for least in (5, 10):
        bad = {line for line, s in sites.items() if len(s) >= least}
        got = line_dedup.remove_boilerplate(docs, min_sites=least).collect()
        assert len(got) == len(rows) and bad
        texts = {r[0]: r[1] for r in rows}
        for r in got:
            t = texts[r.doc_id]
            assert r.text == (None if t is None else "\n".join(x for x in t.split("\n") if x not in bad))
            assert r.n_removed == sum(x in bad for x in (t or "").split("\n"))
    assert line_dedup.remove_boilerplate(no_docs(spark)).count() == 0


# --- Jaccard join


def groups_by_force(texts, words, num, den):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return [len(s) for s in sets], [top(i) for i in range(len(texts))]


def near_texts(rng, n=160):
    vocab = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(vocab, k=rng.randint(2, 120))) for _ in range(12)]
    out = []
    for _ in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("words", "num", "seed"), [(3, 90, 1), (5, 80, 2)])
def test_groups_against_brute_force(spark, words, num, seed):
    texts = near_texts(random.Random(seed)) + [t for t in ODD if t is None or len(t) < 100] + ["A b C", "a B c", "one two", "two one"]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], DOCS)
    sizes, roots = groups_by_force(texts, words, num, 100)
    got = {r.id: r for r in jaccard_join.similar_groups(docs, words=words, num=num).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == roots
    kept = {r.doc_id for r in jaccard_join.one_of_each(docs, words=words, num=num).collect()}
    assert kept == set(roots)


def test_groups_of_odd_tables(spark):
    assert jaccard_join.similar_groups(no_docs(spark)).count() == 0
    rows = [(7, "a b c d e f", None, None), (7, "a b c d e f", None, None), (None, "a b c d e f", None, None), (None, None, None, None), (9, "A B c d e f", None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = jaccard_join.similar_groups(docs).collect()
    assert sorted((str(r.id), str(r.component_id)) for r in got) == [("7", "7"), ("7", "7"), ("9", "7"), ("None", "7"), ("None", "None")]
    assert sorted(str(r.doc_id) for r in jaccard_join.one_of_each(docs).collect()) == ["7", "None", "None"]


def test_an_id_on_several_texts_keeps_each_of_them(spark):
    a, b, c = ("one two three four five six seven", "other words that are like nothing else here", "and a third text of seven words")
    rows = [(7, a, None, None), (9, a, None, None), (9, b, None, None), (9, b, None, None), (11, c, None, None), (12, "", None, None), (12, b, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("label", F.lit("clash")).withColumn("_node", F.lit("clash")).withColumn("N", F.lit(1))
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(7, a), (9, b), (11, c), (12, "")]


def test_groups_of_very_long_texts_and_of_a_large_family(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(4000)]
    long = rng.choices(vocab, k=60000)
    cut = [*long[:40000], "new", *long[40001:]]
    far = rng.choices(vocab, k=60000)
    base = rng.choices(vocab, k=150)
    family = []
    for _ in range(260):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 2, 3, 3, 4, 5, 9])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        family.append(" ".join(w))
    texts = [" ".join(long), " ".join(cut), " ".join(far), "x" * 300000, "x" * 300000 + " y", *family]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], DOCS)
    for words, num in ((3, 90), (5, 80)):
        sizes, roots = groups_by_force(texts, words, num, 100)
        got = {r.id: r for r in jaccard_join.similar_groups(docs, words=words, num=num).collect()}
        assert [got[i].n_shingles for i in range(len(texts))] == sizes
        assert [got[i].component_id for i in range(len(texts))] == roots


# --- licences


def test_the_words_covered_and_their_last_start_by_force():
    def common_length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        return row[-1]

    def _next(row, x, b):
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
        return new

    rng = random.Random(3)
    for _ in range(400):
        template = [rng.randrange(6) for _ in range(rng.randrange(1, 12))]
        window = [rng.randrange(-1, 7) for _ in range(rng.randrange(0, 16))]
        most = common_length(template, window)
        got, first = license_scan.covered(template, window)
        assert got == most
        if most:
            assert first == max(at for at in range(len(window)) if common_length(template, window[at:]) == most)


def test_a_text_of_many_licences_costs_a_pass_over_each_window(monkeypatch):
    index = license_scan.Index(license_scan.TEMPLATES)
    scanner = license_scan.Scanner(index, np.ones(len(index.words), np.int64))
    label, _, _, words = max((t for t in index.templates if t[0] == "mit"), key=lambda t: len(t[3]))
    one = np.array(words)
    seen = []
    covered = license_scan.covered
    monkeypatch.setattr(license_scan, "covered", lambda t, w: seen.append(len(w)) or covered(t, w))
    assert (label, 0, 1.0) in scanner.matches(one)
    alone = sum(seen)
    seen.clear()
    assert (label, 0, 1.0) in scanner.matches(np.tile(one, 20))
    assert sum(seen) < 60 * alone  # follows the text's length, not its square


def test_licenses_base_and_templates(spark):
    mit = [t for label, _, _, t in license_scan.TEMPLATES if label == "mit"][1]
    texts = ["plain words", "x Licensed under the Apache License, Version 2.0. apache license", "see GNU General Public License now", mit.upper() + " tail", " ".join(w for i, w in enumerate(mit.split()) if i != 10), "CC BY-NC 4.0: Licensed under CC BY-NC 4.0.", None, ""]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert got[1].base_found == ["apache"] and got[1].base_starts == [4, 9]
    assert [(m.label, m.first_word) for m in got[1].matches] == [("apache-2.0", 1)]
    assert got[2].base_found == ["gpl"] and got[2].matches == []
    assert [(m.label, m.score) for m in got[3].matches] == [("mit", 1.0)]
    assert [m.label for m in got[4].matches] == ["mit"] and 0.98 < got[4].matches[0].score < 1
    assert got[5].base_starts == [0, 7] and [m.label for m in got[5].matches] == ["cc-by-nc-4.0"]
    for i in (0, 6, 7):
        assert got[i].base_found == [] and got[i].matches == []
    assert license_scan.scan_licenses(no_docs(spark)).count() == 0


def common_words(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above = 0
        for k, y in enumerate(b, 1):
            above, row[k] = row[k], above + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def test_licenses_against_all_alignments(spark):
    rng = random.Random(8)
    index = license_scan.Index()
    scanner = license_scan.Scanner(index, np.arange(len(index.words))[::-1].copy())
    for turn in range(40):
        label, need, keys, template = rng.choice(license_scan.TEMPLATES)
        words = template.split()
        for _ in range(rng.randint(0, max(1, len(words) // 6))):
            words[rng.randrange(len(words))] = rng.choice(["zzz", "the", "license"])
        if len(words) > 20 and turn % 2:
            del words[rng.randrange(len(words))]
            words.insert(rng.randrange(len(words)), "zzz")
        text = " ".join(["noise"] * rng.randint(0, 5) + words + ["the"] * 3).encode()
        ids = index.of(text)
        must, may = set(), set()
        for name, share, phrases, numbers in index.templates:
            n = len(numbers)
            for start in range(len(ids)):  # every word where it is in the template
                window = ids[start : start + n]
                if np.sum(window == numbers[: len(window)]) / n >= share and all(len(license_scan.places(window, p)) for p in phrases):
                    must.add(name)
            if common_words(numbers.tolist(), ids.tolist()) / n >= share and all(len(license_scan.places(ids, p)) for p in phrases):
                may.add(name)
        got = {m[0] for m in scanner.matches(ids)}
        assert must <= got <= may, (template, text)
        if label in may and len(words) > 20:  # one word less and one more
            assert label in got


# --- decontamination


def hits_by_force(text, items, n):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for i, t in items:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        size = min(n, len(v))
        for k in range(len(v) - size + 1) if v else ():
            for at in range(len(w) - size + 1):
                if w[at : at + size] == v[k : k + size]:
                    hit.update(range(at, at + size))
                    found.add(i)
    return len(w), hit, sorted(found)


@pytest.mark.parametrize("block", [decontamination.BLOCK_WINDOWS, 7])
def test_hits_against_brute_force(spark, block):
    rng = random.Random(4)
    vocab = ["aa", "b", "Cc", "d1", "é", "ff"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 2, 5, 12, 15])))) for i in range(9)] + [(9, None), (3, "again aa b")]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(0, 60))) for _ in range(30)] + ["x, " + items[4][1].upper() + "! y", None, ""]
    docs = spark.createDataFrame([(i, t, None, None, "c") for i, t in enumerate(texts)], f"{DOCS}, n_words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_hits(docs, bench, block_windows=block).collect()
    assert len(got) == len(texts)
    for r in got:
        n, hit, found = hits_by_force(texts[r.doc_id], items, 10)
        assert (r.n_words, r["items"]) == (n, found)
        assert {k for a, b in decontamination.spans(r.hit_words) for k in range(a, b)} == hit
    clean = {r.doc_id for r in decontamination.decontaminate(docs, bench, mode="documents").collect()}
    assert clean == {i for i, t in enumerate(texts) if not hits_by_force(t, items, 10)[1]}
    assert decontamination.find_hits(no_docs(spark), bench).count() == 0


def test_spans_are_cut_out(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    text = "Keep, this. One two-three four (five) six seven eight nine TEN! And that."
    docs = spark.createDataFrame([(1, text, "en", "s"), (2, "clean", "en", "s"), (3, None, None, None)], DOCS)
    got = {r.doc_id: r.text for r in decontamination.decontaminate(docs, bench).collect()}
    assert got == {1: "Keep, this. ! And that.", 2: "clean", 3: None}


# --- nearest neighbours


@pytest.mark.parametrize("shared", [nearest.SHARED_BYTES, 0])
def test_nearest_recall_and_scores(spark, shared):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[50:80] = x[50]  # a common vector
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)] + [(1000, None, "c"), (1001, [0.0] * 8, "c"), (1002, [float("nan")] + [1.0] * 7, "c"), (1003, [None] + [1.0] * 7, "c"), (1004, [1.0], "c"), (None, x[0].tolist(), "c"), (0, x[0].tolist(), "c")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = nearest.nearest(table, F.col("id") % 50 == 0, shared_bytes=shared).toPandas()
    norm = np.linalg.norm(x.astype(float), axis=1)
    right = 0
    for q in range(0, 300, 50):
        s = x.astype(float) @ x[q].astype(float) / norm / norm[q]
        order = [i for i in np.lexsort((np.arange(300), -np.round(s, 12))) if i != q][:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == [1, 2, 3, 4, 5] and q not in set(mine.vec_id)
        assert np.allclose(mine.score, s[mine.vec_id], atol=1e-12)
        right += len(set(order) & set(mine.vec_id))
    assert right >= 0.9 * 30
    assert list(got[got.query_id == 50].vec_id) == [51, 52, 53, 54, 55]


def test_nearest_of_few_rows(spark):
    kind = "vec_id long, embedding array<float>"
    assert nearest.nearest(spark.createDataFrame([], kind), F.col("id") % 50 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8])], kind)
    assert [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in nearest.nearest(two, F.col("id") % 50 == 0).collect()] == [(0, 1, 1, 0.6)]


# --- shared helpers


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 102), (101, 102)]
    got = {r.node: r.label for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(21)) and all(got[i] == 100 for i in (100, 101, 102))
