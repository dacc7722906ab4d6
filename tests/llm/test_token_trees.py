"""Operator 2: the query against a plain encoder, and kept trees under a table of edits."""

import random

import public_tokenizers
import tiktoken
from compare import SF

from framewright.llm import bpe, common, tokens
from framewright.llm.queries import QUERIES

PLAIN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.vocabulary()), special_tokens={})


def test_query(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op2_token_counts"](spark, SF).collect()
    assert len(got) == len(texts) and sum(r["n_edits"] for r in got) > 0
    for r in got:
        text = after = texts[r["doc_id"]]
        edits = tokens.redactions(text)
        for e in edits:
            after = after[: e.start] + e.text + after[e.end :]
        assert (r["n_tokens"], r["n_edits"], r["n_tokens_edited"]) == (len(PLAIN.encode_ordinary(text)), len(edits), len(PLAIN.encode_ordinary(after)))
        assert r["n_encoded"] <= r["n_pieces"] + 20 * len(edits)


def test_kept_trees_follow_a_table_of_edits(spark, docs):
    r = random.Random(6)
    texts = {i: " ".join(r.choice(["It's", "12", "o'clock", "é", "\n\n", "word", "!!"]) for _ in range(r.choice([0, 1, 40, 3000]))) for i in range(12)}
    rows = [*texts.items(), (3, texts[3]), (None, "alone"), (77, None)]
    kept = common.written(tokens.trees(docs(rows)))
    assert {(x["doc_id"], x["n_tokens"]) for x in kept.collect()} == {(d, len(PLAIN.encode_ordinary(t or ""))) for d, t in rows}
    edits = []
    want = dict(texts) | {77: ""}
    for seq in range(60):
        d = r.choice([0, 1, 2, 3, 4, 77])
        a = r.randint(0, len(want[d]))
        z, new = a + r.choice([0, 2, 30]), r.choice(["", " x", "'s 7", None])
        edits.append((d, seq, a, z, new))
        want[d] = want[d][:a] + (new or "") + want[d][z:]
    edits += [(None, 0, 0, 5, "lost"), (500, 0, 0, 5, "lost"), (5, 1, None, None, "all new")]
    want[5] = "all new"
    table = spark.createDataFrame(edits, "doc_id long, seq long, start long, end long, text string")
    done = common.written(tokens.edited(kept, table.repartition(5)))
    for x in done.collect():
        text = want[x["doc_id"]] if x["doc_id"] is not None else "alone"
        assert (x["text"], x["n_tokens"], sum(x["counts"]), sum(x["sizes"])) == (text, len(PLAIN.encode_ordinary(text)), x["n_tokens"], len(text))
        if x["doc_id"] not in {e[0] for e in edits}:
            assert x["n_encoded"] == 0
    again = tokens.edited(done, spark.createDataFrame([(4, 0, 0, 0, "front ")], table.schema)).where("doc_id = 4").first()
    assert again["text"] == "front " + want[4] and again["n_tokens"] == len(PLAIN.encode_ordinary(again["text"])) and again["n_encoded"] < 10
    assert tokens.edited(kept.where("false"), table).count() == 0 and tokens.edited(kept, table.where("false")).count() == len(rows)
