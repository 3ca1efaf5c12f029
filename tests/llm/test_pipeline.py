"""The pipeline's stages, one by one and in a row, against plain versions of what each should keep."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from kinmerge.llm import bpe, mixing, secrets, simhash, toxicity

RND = random.Random(6)
WORDS = [f"word{i}" for i in range(400)]
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _h string, h int, ids string, n int, taken string"


def some(n):
    return " ".join(RND.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    texts = [(i, some(RND.randint(5, 80)) + (" vile scum vermin" if i % 9 == 0 else "")) for i in range(360)]
    texts += [(400 + i, texts[i][1]) for i in range(40)]  # copies
    texts += [(500, None), (501, ""), (502, "token=abcdefgh " + some(20)), (503, some(30_000)), (None, some(12)), (504, texts[7][1]), (504, texts[7][1]), (505, "  ")]
    rows = [(i, t, "en", RND.choice(["a", "a", "b", None]), len(t or ""), f"own{k}", k, "mine", 7, "x") for k, (i, t) in enumerate(texts)]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(path + "/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 == 0), 1) for i in range(0, 360, 2)], "doc_id bigint, toxic int, quality int").write.parquet(path + "/labels.parquet")
    return path


def test_stages_in_a_row(spark, folder, tmp_path):
    docs = spark.read.parquet(folder + "/documents.parquet")
    before = docs.collect()
    assert [name for name, _ in P.STAGES] == ["toxicity", "simhash", "secrets", "mixing", "bpe"]
    for name, stage in P.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        after = now.collect()
        key = lambda r: (r["doc_id"], r["text"])
        if name != "bpe":
            assert now.columns == docs.columns
            assert name == "mixing" or all(r["_h"] == f"own{r['h']}" and (r["ids"], r["n"], r["taken"]) == ("mine", 7, "x") for r in after)
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(folder + "/labels.parquet"))
            bad = {(r["doc_id"]): r["predicted"] for r in toxicity.score(docs, model).collect()}
            assert sorted(map(str, after)) == sorted(str(r) for r in before if not bad[r["doc_id"]])
            assert not any("vermin" in (r["text"] or "") for r in after) and len(after) > 350
        elif name == "simhash":
            components = {}
            for r in simhash.near_duplicates(docs).collect():
                components.setdefault(r["component_id"], set()).add(r["doc_id"])
            assert sorted(map(str, (r["doc_id"] for r in after))) == sorted(map(str, components))
            assert len({r["text"] for r in after}) == len(after)
        elif name == "secrets":
            assert sorted(map(str, map(key, after))) == sorted(str((r["doc_id"], r["text"] and secrets.redacted(r["text"].encode()).decode())) for r in before)
            assert any("[secret]" in (r["text"] or "") for r in after) and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in after)
        elif name == "mixing":
            taken = {r["doc_id"]: r["taken"] for r in mixing.Mix(docs).taken().collect()}
            got = {}
            for r in after:
                got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].split())
            assert got == {i: n for i, n in taken.items() if n}
            whole = {r["doc_id"]: r["text"].split() for r in before if r["text"]}
            for r in after:  # runs of the text's own words, in order
                words = iter(whole[r["doc_id"]])
                assert all(w in words for w in r["text"].split())
        else:
            library = Tokenizer.from_file(bpe.default_path())
            want = sorted((str(r["doc_id"]), str(r["source"]), library.encode(r["text"] or "", add_special_tokens=False).ids) for r in before)
            assert sorted((str(r["doc_id"]), str(r["source"]), r["ids"]) for r in after) == want and all(r["n_tokens"] == len(r["ids"]) for r in after)
        docs, before = now, after


def test_run_is_the_stages_and_agrees_with_itself(spark, folder):
    one, two = (sorted((str(r["doc_id"]), r["n_tokens"], np.array(r["ids"]).tobytes()) for r in P.run(spark, folder).collect()) for _ in range(2))
    assert one == two and len(one) > 100


def test_empty_tables(spark, folder, tmp_path):
    path = str(tmp_path)
    spark.read.parquet(folder + "/documents.parquet").limit(0).write.parquet(path + "/documents.parquet")
    spark.read.parquet(folder + "/labels.parquet").limit(0).write.parquet(path + "/labels.parquet")
    assert P.run(spark, path).count() == 0
    docs = spark.read.parquet(path + "/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, path).count() == 0
