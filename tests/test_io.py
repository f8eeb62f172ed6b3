"""Sources, sinks, streams and quota rules."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from provalake.operators import quota as U
from provalake.operators.windows import history
from provalake.sources import tables as S
from provalake.streaming import ingest as SI
from provalake.streaming import quota as SQ
from provalake.streaming import status as SS


def put(path, name, text):
    os.makedirs(path, exist_ok=True)
    (path / name).write_text(text, encoding="utf-8")


def test_question_files(spark, tmp_path):
    doc = {"metadados": {"banca": "FCC", "ano": 2023}, "questoes": [{"numero": 2, "alternativas": {"A": "x"}}, {"numero": 1}], "classificacoes": [{"questao_numero": 1, "assunto": "S"}]}
    put(tmp_path, "a.json", json.dumps(doc, indent=1))
    put(tmp_path, "b.json", '{"questoes": [')
    put(tmp_path, "c.txt", "nada")
    rows = S.scan_questions_json(spark, str(tmp_path / "a.json")).orderBy("seq").collect()
    assert [(r.numero, r.banca) for r in rows] == [(2, "FCC"), (1, "FCC")]
    assert S.scan_classifications_json(spark, str(tmp_path / "a.json")).first().assunto == "S"
    good, errors = S.scan_dir(spark, str(tmp_path))
    assert good.count() == 2
    assert [os.path.basename(r.arquivo) for r in errors.collect()] == ["b.json"]


def test_packed_question_files_read_like_single_ones(spark, tmp_path):
    docs = {"a.json": {"metadados": {"banca": "FCC", "ano": 2023}, "questoes": [{"numero": 2, "alternativas": {"A": "x"}}, {"numero": 1}]},
            "d.json": {"metadados": {"banca": "IBFC"}, "questoes": []}, "e.json": {"questoes": [{"numero": 7, "enunciado": "dois\nlados"}]}}
    texts = {k: json.dumps(v, indent=1) for k, v in docs.items()} | {"b.json": '{"questoes": [', "c.txt": "nada"}
    for name, text in texts.items():
        put(tmp_path / "single", name, text)
    files = spark.createDataFrame([(f"x/{k}", v) for k, v in texts.items()], "arquivo string, value string").coalesce(1)
    S.pack_files(files, str(tmp_path / "packed"))
    assert len([f for f in os.listdir(tmp_path / "packed") if f.endswith(".parquet")]) == 1
    rows = lambda df: sorted(map(str, df.withColumn("arquivo", F.element_at(F.split("arquivo", "/"), -1)).collect()))
    assert rows(S.scan_questions_json(spark, str(tmp_path / "packed"), packed=True)) == rows(S.scan_questions_json(spark, str(tmp_path / "single")))
    for one, many in zip(S.scan_dir(spark, str(tmp_path / "single")), S.scan_dir(spark, str(tmp_path / "packed"), packed=True)):
        assert rows(one) == rows(many)


def test_sinks(spark, tmp_path):
    q = spark.createDataFrame([(1, "D"), (2, "E")], "questao_id int, disciplina string")
    S.sink_json(q, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    S.sink_report(q.select("disciplina", F.lit("# md\nlinha").alias("markdown")), str(tmp_path / "r"))
    assert sorted(p for p in os.listdir(tmp_path / "r") if "=" in p) == ["disciplina=D", "disciplina=E"]
    bad = q.select(F.raise_error(F.lit("boom")).alias("x"))
    with pytest.raises(Exception, match="boom"):
        S.sink_related(q, q, bad, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t" / "questoes")).count() == 2


def test_accept_files(spark, tmp_path):
    put(tmp_path, "ok.pdf", "x")
    put(tmp_path, "big.PDF", "x" * 100)
    put(tmp_path, "no.txt", "x")
    rows = {os.path.basename(r.path): r.motivo for r in S.accept_files(S.list_files(spark, str(tmp_path)), max_bytes=50).collect()}
    assert rows == {"ok.pdf": None, "big.PDF": "tamanho", "no.txt": "tipo"}


def test_spread_only_moves_small_inputs(spark):
    assert S.spread(spark.range(0, 100, 1, 1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, 64)
    assert S.spread(many, "id") is many


@pytest.mark.parametrize("pct,status", [(75, "warning"), (95, "critical"), (55, "moderate"), (1, "healthy")])
def test_quota_status(spark, pct, status):
    used = spark.createDataFrame([("groq", pct, 0, 0)], "provider string, requests_today int, tokens_today int, requests_this_minute int")
    row = U.quota_status(used, U.limits(spark, [("groq", 10, 100, 10, 100)])).first()
    assert row.status == status and (row.recommendations == ["Quota saudável - operações normais disponíveis"]) == False  # noqa: E712 - fewer than 100 left
    assert U.quota_status(used, U.limits(spark)).first().status == "healthy"


def test_quota_check_order(spark):
    cols = "provider string, requests_today int, tokens_today int, requests_this_minute int"
    rows = [("groq", 100, 100, 10), ("groq", 1, 100, 10), ("groq", 1, 100, 1), ("groq", 1, 1, 1), ("other", 1, 1, 1)]
    got = [r.reason for r in U.quota_check(spark.createDataFrame(rows, cols).coalesce(1), U.limits(spark, [("groq", 10, 100, 10, 100)])).collect()]
    assert got == ["Daily request limit reached (100)", "Per-minute request limit reached (10)", "Daily token limit reached (100)", None, "Unknown provider: other"]


def events(spark, n=500):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=i * 17 % 4000 + i), "groq" if i % 3 else "anthropic", i % 50, i % 7 != 0) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, provider string, tokens_used int, success boolean")


def test_history_and_current_usage(spark):
    h = history(events(spark))
    assert {r["count"] for r in h.groupBy("provider").count().collect()} == {100}
    now = {r.provider: r for r in U.current_usage(events(spark)).collect()}
    assert sum(r.requests_today for r in now.values()) == 500


def run(df, spark, tmp_path, mode="append"):
    df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode(mode).trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(str(tmp_path / "out"))


def source(spark, tmp_path, df, files=4):
    df.repartition(files, "event_id").write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_stream_minutes_equal_batch(spark, tmp_path):
    ev = events(spark)
    got = run(SQ.tumbling_usage(source(spark, tmp_path, ev), watermark="2 hours"), spark, tmp_path)
    want = {(r.provider, r.inicio): (r.requests, r.tokens) for r in U.usage(ev.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    rows = {(r.provider, r.inicio): (r.requests, r.tokens) for r in got.collect()}
    assert all(want[k] == v for k, v in rows.items())


def test_stream_anchored_equals_batch(spark, tmp_path):
    ev = events(spark)
    last = ev.agg(F.max("ts")).first()[0]
    tail = spark.createDataFrame([(10**6 + i, last + dt.timedelta(hours=9 + i), p, 0, True) for i in range(2) for p in ("groq", "anthropic")], ev.schema)
    ev.write.parquet(str(tmp_path / "in" / "a"))
    stream = spark.readStream.schema(ev.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = SQ.anchored_usage(stream, "2 hours")
    start = lambda: out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode(
        "append").trigger(availableNow=True).start().awaitTermination()
    start()
    tail.write.parquet(str(tmp_path / "in" / "b"))  # later rows push the watermark past everything above
    start()
    got = {(r.provider, r.anchor): (r.requests, r.tokens) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()}
    want = {(r.provider, int(r.anchor)): (r.requests, r.tokens) for r in U.anchored_minute(ev).collect()}
    assert got and all(want[k] == v for k, v in got.items())
    assert len(got) >= len(want) - 2  # the last window of each provider may still be open


def test_stream_anchored_state_holds_times_not_rows(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=40 * (i % 6)), "groq", 1, True) for i in range(6000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, provider string, tokens_used int, success boolean").write.parquet(str(tmp_path / "in" / "a"))
    stream = spark.readStream.schema("event_id long, ts timestamp, provider string, tokens_used int, success boolean").option(
        "recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = SQ.anchored_usage(stream, "1 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    first = next(p for p in q.recentProgress if p["numInputRows"])
    assert [o["numRowsTotal"] for o in first["stateOperators"] if o["operatorName"] == "stateStoreSave"] == [6]  # what waits
    got = sorted((r.anchor // 1_000_000 - int(start.replace(tzinfo=dt.timezone.utc).timestamp()), r.requests, r.tokens) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, 2000, 2000), (80, 2000, 2000)]  # the last one is open


def test_latest_status(spark):
    df = spark.createDataFrame([(1, 1, "pending", 0), (1, 3, "completed", 1), (1, 3, "failed", 2), (2, 1, "retry", 3)], "prova_id int, ts int, queue_status string, event_id int")
    assert {r.prova_id: r.queue_status for r in SS.latest_status(df).collect()} == {1: "failed", 2: "retry"}


def test_status_table_over_batches_and_replays(spark, tmp_path):
    rows = [(1, 1, "pending", 0), (1, 3, "completed", 1), (2, 1, "retry", 2), (1, 3, "failed", 3), (3, 9, "partial", 4), (2, 0, "pending", 5), (1, 2, "retry", 6)]
    schema = "prova_id int, ts int, queue_status string, event_id int"
    for i, row in enumerate(rows):
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "tabela")
    go = lambda: SS.start_latest_status(stream, out, str(tmp_path / "cp"))
    q = go()
    q.awaitTermination()
    state = lambda d: sorted((r.prova_id, r.queue_status, r.mudancas) for r in d.collect())
    want = [(1, "failed", 4), (2, "retry", 2), (3, "partial", 1)]
    assert len(q.recentProgress) >= 3 and state(SS.current_status(spark, q, out)) == want
    last = max(p["batchId"] for p in q.recentProgress if p["numInputRows"])
    again = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")).filter("event_id = 6")
    before = state(spark.read.parquet(SS.version_path(out, last)))
    replay = spark.createDataFrame([r for r in rows if r not in _seen(spark, out, last, rows)], schema)
    SS.merge_batch(out)(replay, last)
    assert state(spark.read.parquet(SS.version_path(out, last))) == before and again.count() == 1


def _seen(spark, out, last, rows):
    """Rows that came before the last micro-batch: as many changes of each exam as the version before counts."""
    counted = {r.prova_id: r.mudancas for r in spark.read.parquet(SS.version_path(out, last - 1)).collect()}
    seen = []
    for row in rows:
        if counted.get(row[0], 0):
            counted[row[0]] -= 1
            seen.append(row)
    return seen


def test_ingest_files(spark, tmp_path):
    exam = "Informática\nQuestão 1 (Correta: B)\nQual é o atalho para copiar um texto selecionado no editor?\nA) a\nB) b\nC) c\nD) d\nE) e"
    put(tmp_path / "in", "p1.txt", exam)
    put(tmp_path / "in", "p2.txt", "sem questões")
    go = lambda: SI.start_ingest(SI.read_exam_files(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    go()
    exams = {r.prova_id: (r.status, r.error_code) for r in SI.current_exams(spark, str(tmp_path / "out")).collect()}
    assert exams == {"p1": ("completed", None), "p2": ("failed", "NO_QUESTIONS")}
    put(tmp_path / "in", "p3.txt", exam + "\nQuestão 2\ncurta\nA) a")
    go()
    go()
    exams = {r.prova_id: r.status for r in SI.current_exams(spark, str(tmp_path / "out")).collect()}
    assert exams["p3"] == "partial" and len(exams) == 3
    assert SI.current_questions(spark, str(tmp_path / "out")).count() == 3


def test_exam_sent_again_without_questions(spark, tmp_path):
    out = str(tmp_path / "out")
    old = spark.createDataFrame([("p1", 1, 0), ("p2", 1, 0)], "prova_id string, numero int, lote int")
    for batch, rows in ((0, old), (1, old.filter("false"))):
        rows.write.parquet(f"{out}/questoes/batch={batch}")
    for batch, ids in ((0, ["p1", "p2"]), (1, ["p1"])):
        spark.createDataFrame([(i, batch) for i in ids], "prova_id string, lote int").write.parquet(f"{out}/provas/batch={batch}")
    assert [r.prova_id for r in SI.current_questions(spark, out).collect()] == ["p2"]


def test_streams_read_a_table_in_one_file_or_in_a_folder(spark, tmp_path):
    from provalake.catalog.q_vectors import stream_ingest

    docs = spark.createDataFrame([(i, "texto " * 12, "pt", "a", 72) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/folder/documents.parquet")
    docs.toPandas().to_parquet(f"{tmp_path}/documents.parquet", index=False)
    for place in (tmp_path / "folder", tmp_path):
        assert {(r.prova_id, r.status) for r in stream_ingest(spark, str(place)).collect()} == {(i, "completed") for i in range(6)}


def test_marks_inside_a_document_are_part_of_the_stem(spark, tmp_path):
    from provalake.catalog.q_vectors import stream_ingest

    w = "palavra " * 12
    texts = [w, f"{w}Questão 7 {w}", f"{w}12. [a] 13. [b] {w}", f"{w}anulada", f"(Correta: C) {w}", f"x (C) 2020 {w}", f"{w}Resposta: C", f"{w}A) um B) dois C) três"]
    rows = [(i, t, "pt", "a", 0) for i, t in enumerate([*texts, f"curto, muito curto (D) {w}"])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.prova_id: (r.status, r.questoes_count, r.questoes_revisao, r.confianca_media) for r in stream_ingest(spark, str(tmp_path)).collect()}
    assert got == {i: ("completed", 1, 0, 95.0) for i in range(9)}
