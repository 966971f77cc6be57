"""Very long texts, columns with the names of results, ties and repeated rows, through each operator."""

import random

from pyspark.sql import functions as F

from spotweave.llm import chat_format, decontamination, jaccard_join, language_id, license_scan, line_dedup, sentence_pieces, token_counts
from tests.llm.test_llm import BPE, PIECES, hits_by_force

CLASH = ["n_words", "labels", "matches", "base_starts", "node", "label", "n", "prefix", "hit_words", "items", "decoded", "n_lines", "_bad", "_ka", "_text", "_own", "token", "score", "bucket"]


def long_docs(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(900)]
    words = rng.choices(vocab, k=150_000)
    item = " ".join(rng.choices(vocab, k=14))
    notice = "Released under the MIT License"
    texts = [" ".join(words[:100_000] + [item, notice] + words[100_000:]), "\n".join(" ".join(words[k : k + 9]) for k in range(0, 90_000, 9)), "y" * 400_000, item, None, ""]
    rows = [(i, t, f"s{i}") for i, t in enumerate(texts)] + [(0, texts[0], "s9"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in CLASH})
    return docs, texts, item


def test_each_operator_takes_long_texts_and_clashing_columns(spark):
    docs, texts, item = long_docs(spark)
    found = license_scan.scan_licenses(docs).collect()
    assert len(found) == 8 and [r.n_words for r in found if r.doc_id == 0] == [150_019] * 2
    assert all([m.label for m in r.matches] == (["mit"] if r.doc_id == 0 else []) for r in found)
    benchmark = spark.createDataFrame([(7, item), (7, item), (8, None), (None, item)], "item_id long, text string")
    found = decontamination.find_hits(docs, benchmark).collect()
    for r in found:
        _, hit, ids = hits_by_force(r.text, [(7, item)], 10)
        assert sum(r.hit_words or b"") == (hit if isinstance(hit, int) else len(hit)) and set(map(str, r["items"])) == set(map(str, ids))
    found = line_dedup.remove_boilerplate(docs, min_sites=2).collect()
    assert [r.text for r in found if r.doc_id == 0] == ["", ""] and [r.n_removed for r in found if r.doc_id == 1] == [0]
    assert all(r.token == "clash" for r in found)
    groups = jaccard_join.similar_groups(docs).collect()
    assert sorted((r.n_shingles > 0, str(r.component_id)) for r in groups if r.id == 0) == [(True, "0")] * 2
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["0", "1", "2", "3", "4", "5", "None"]
    counts = {r.doc_id: r for r in token_counts.count_tokens(docs, BPE).collect()}
    assert counts[2].n_bytes == 400_000 and counts[4].n_tokens == 0 and counts[0].n_tokens > 150_000
    pieces = {r.doc_id: r for r in sentence_pieces.encode_and_decode(docs, PIECES).collect()}
    assert all(pieces[i].decoded == t for i, t in enumerate(texts))


def test_languages_that_tie_go_to_the_first(spark):
    rows = [(i, f"same words in both {i % 3}", lang) for i, lang in enumerate(["bb", "aa"] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert {r.lang_pred for r in language_id.identify(docs, model).collect()} == {"aa"}


def test_preferences_with_null_turns_and_sides(spark):
    turn = "array<struct<role:string,text:string>>"
    rows = [(1, [("user", "q"), None], [("user", "q")]), (2, None, [("user", "q"), ("assistant", "a")]), (3, [("user", None)], [("user", "")]), (4, None, None), (5, [("user", "q"), ("assistant", "z" * 300_000)], [("user", "q"), ("assistant", "b")])]
    pairs = spark.createDataFrame(rows, f"conv_id long, chosen {turn}, rejected {turn}").withColumns({"prompt": F.lit("clash"), "_n": F.lit(5), "_sides": F.lit(6)})
    got = {r.conv_id: r for r in chat_format.format_preferences(pairs).collect()}
    assert [got[i].n_prompt_turns for i in range(1, 6)] == [1, 0, 1, 0, 1]
    assert got[1].chosen_text == "<|im_start|>\n<|im_end|>\n" and got[1].rejected_text == "" and got[2].chosen_text == ""
    turn_of_q = len("<|im_start|>user\nq<|im_end|>\n")
    first = turn_of_q + len("<|im_start|>assistant\n")
    assert got[2].rejected_mask == [f"{first}-{first + len('a<|im_end|>')}"]
    assert got[3].prompt == "<|im_start|>user\n<|im_end|>\n" and got[4].prompt == "" and len(got[5].chosen_text) > 300_000
    assert got[1]._n == 5 and got[1]._sides == 6
