"""The registered queries and the pipeline on whole small tables."""

import hashlib

import pytest

from oracle import same, sql_rows


@pytest.fixture(scope="module")
def llm():
    from seriescope.llm import queries

    return queries


def test_queries_equal_sql(spark, sf, llm):
    for name, sql in llm.ORACLE_SQL.items():
        same(llm.QUERIES[name](spark, sf).toPandas(), sql_rows(sql, sf))


COLUMNS = {
    "op1": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op2": ["doc_id", "fingerprint", "component_id"],
    "op3": ["doc_id", "held_out", "lang_pred", "score"],
    "op5": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op7": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op8": ["page_id", "url", "text", "n_chars"],
    "op9": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op10": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
}


def test_columns_of_the_contract(spark, sf, llm):
    for name, q in llm.QUERIES.items():
        df = q(spark, sf) if name != "pipeline" else None
        if df is not None:
            want = COLUMNS.get(name.split("_")[0], [])
            assert df.columns[: len(want)] == want
            assert df.count() > 0
    kinds = dict(llm.QUERIES["op9_linear_grouping_packing"](spark, sf).dtypes)
    assert kinds["piece"] == "int" and {kinds[c] for c in ("start", "length", "ids_crc32", "sequence_id", "offset")} == {"bigint"}


def test_chat_query_equals_brute_force(spark, sf, llm):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect()
    probe = "</s>[INST] ok [/INST]"
    chats = {-1: [("user", probe), ("assistant", probe)]}
    for r in turns:
        chats.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = llm.QUERIES["op10_typed_chat_formatting"](spark, sf).collect()
    assert len(got) == len(chats)
    for r in got:
        c = chats[r.conv_id]
        loss = "".join(t for role, t in c if role == "assistant")
        assert r.n_turns == len(c) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in c).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_queries_equal_brute_force(spark, sf, llm):
    """The queries without SQL, over their whole small tables."""
    import zlib

    from seriescope.llm.tokens import public_vocabulary
    from test_operators import article_of, brute_entropy_spans, brute_fingerprint, brute_groups, brute_language, brute_spans, brute_statistics, check_packing

    def rows_of(name):
        return {r[0]: r for r in llm.QUERIES[name](spark, sf).collect()}

    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(text)
    got = rows_of("op2_simhash_covering")
    prints = [brute_fingerprint(text[i]) for i in ids]
    assert [got[i].fingerprint for i in ids] == [f"{x:016x}" for x in prints]
    assert [got[i].component_id for i in ids] == [ids[g] for g in brute_groups(prints)]

    got = rows_of("op3_compression_language")
    learned = llm.language.learn(spark.read.parquet(f"{sf}/documents.parquet"))
    assert [(got[i].held_out, got[i].lang_pred) for i in ids] == [(zlib.crc32(str(i).encode()) % 3 == 1, brute_language(text[i], learned)) for i in ids]

    got = rows_of("op5_isolation_forest")
    for i in ids:
        s = brute_statistics(text[i])
        assert tuple(got[i])[1:6] == s and got[i].base_failed == (s[0] < 50 or 100 * s[4] > 50 * s[0])
        assert not (got[i].base_failed and got[i].kept)

    got, encode = rows_of("op6_edit_aware_counts"), public_vocabulary().encoder()
    for i in ids:
        t = text[i]
        at = zlib.crc32(str(i).encode()) % (len(t) + 1)
        after = t[:at] + " a replaced passage" + t[min(at + 12, len(t)) :]
        half = len(t) // 2
        after = after[:half] + "inserted here, " + after[half:]
        assert (got[i].n_before, got[i].n_after) == (len(encode(t)), len(encode(after)))

    got = rows_of("op7_entropy_secrets")
    for i in ids:
        base = brute_spans(text[i])
        said = [",".join(f"{llm.secrets.KINDS[k]}:{a}:{b}" for a, k, b in x) for x in (base, sorted(base + brute_entropy_spans(text[i])))]
        assert got[i].spans == said[1] and got[i].base_sha256 == hashlib.sha256(said[0].encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == kind for _, k, _ in base) for kind in range(3))

    got = rows_of("op8_line_block_extraction")
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        assert (got[r.page_id].url, got[r.page_id].text, got[r.page_id].n_chars) == (r.url, article_of(r.html), len(article_of(r.html)))

    found = llm.QUERIES["op9_linear_grouping_packing"](spark, sf).toPandas()
    found["doc_id"] = found["doc_id"].map({x: i for i, x in enumerate(ids)})
    used, least = check_packing(found, [text[i] for i in ids])
    assert used <= least * 1.01 + 2


def test_pipeline_stage_by_stage(spark, sf, tmp_path):
    """Each stage keeps what brute force keeps of its own input."""
    import corpus_pipeline
    from test_operators import brute_contamination, brute_fingerprint, brute_groups, brute_spans, brute_statistics, check_packing

    d = spark.read.parquet(f"{sf}/documents.parquet")
    columns = d.columns
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in d.collect()}
        stage(spark, d, sf).write.parquet(str(tmp_path / str(k)))
        d = spark.read.parquet(str(tmp_path / str(k)))
        if name == "best_fit_packing":
            found = d.toPandas()
            ids = sorted(before)
            found["doc_id"] = found["doc_id"].map({x: i for i, x in enumerate(ids)})
            used, least = check_packing(found, [before[i] for i in ids])
            assert used <= least * 1.05 + 1
            continue
        assert d.columns == columns
        after = {r.doc_id: r.text for r in d.collect()}
        if name == "quality_rules":
            for i, t in before.items():
                s = brute_statistics(t)
                if s[0] < 50 or 100 * s[4] > 50 * s[0]:
                    assert i not in after
            assert len(after) > 0.6 * len(before)
        elif name == "near_duplicates":
            ids = sorted(before)
            groups = brute_groups([brute_fingerprint(before[i]) for i in ids])
            assert set(after) == {ids[g] for g in set(groups)}
        elif name == "decontamination":
            ids = sorted(before)
            bad = [x[3] for x in brute_contamination([before[i] for i in ids], bench)]
            assert set(after) == {i for i, b in zip(ids, bad, strict=True) if not b}
        elif name == "secret_scan":
            assert set(after) == set(before)
            for i, t in before.items():
                for a, _, b in brute_spans(t or ""):
                    assert t[a:b] not in after[i]
                if not brute_spans(t or "") and "<secret>" not in after[i]:
                    assert after[i] == t
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, sf).count() == d.count()


def test_pipeline_of_odd_tables(spark, sf, tmp_path):
    """Nulls, repeated rows, clashing columns, and no rows at all."""
    import corpus_pipeline
    from pyspark.sql import functions as F
    from test_operators import odd

    good = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id < 40")
    tables = {"odd": odd(spark).unionByName(good, allowMissingColumns=True), "empty": odd(spark).limit(0), "nulls": odd(spark).withColumn("text", F.lit(None).cast("string"))}
    for name, d in tables.items():
        folder = str(tmp_path / name)
        d.write.parquet(f"{folder}/documents.parquet")
        for other in ("labels", "benchmark"):
            t = spark.read.parquet(f"{sf}/{other}.parquet")
            (t.limit(0) if name == "empty" else t).write.parquet(f"{folder}/{other}.parquet")
        found = corpus_pipeline.run(spark, folder)
        assert found.columns == COLUMNS["op9"]
        assert (found.count() > 0) == (name == "odd")


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from seriescope.llm.common import shared_folder

    def session(master, named):
        made = []
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: named))

    with pytest.raises(ValueError):
        shared_folder(session("spark://host:7077", None))
    assert shared_folder(session("spark://host:7077", "/shared")) == "/shared"
    assert "spark-checkpoint-" in shared_folder(session("local[2]", None))


@pytest.mark.parametrize("name", ["op1_winnowing_decontamination", "op2_simhash_covering", "op6_edit_aware_counts", "op7_entropy_secrets", "op8_line_block_extraction"])
def test_scans_read_needed_columns_only(spark, sf, llm, name):
    import re

    read = {"op8_line_block_extraction": {"page_id", "url", "html"}}.get(name, {"doc_id", "text"})
    plan = llm.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoop", llm.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString())
    for cols in re.findall(r"Project \[([^\]]*)\]\n[ :+-]*Relation", plan):
        assert {re.sub(r"#.*", "", c.strip()) for c in cols.split(",")} <= read or "AS" in cols
