import struct

import pytest
from pyspark.sql import functions as F

from vektorloom.functions import text as tx
from vektorloom.functions.units import epoch_us, run_started_at
from vektorloom.operators import ranking
from vektorloom.plans import run_report
from vektorloom.sources import documents, files, framed, logs, tables


def number(value):
    value &= (1 << 64) - 1
    out = b""
    while value > 127:
        out += bytes([value & 127 | 128])
        value >>= 7
    return out + bytes([value])


def field(no, kind, body):
    return number(no << 3 | kind) + body


def message(fields, row):
    """Encode a nested dict with the reader's field tables."""
    out = b""
    for no, spec in fields.items():
        value = row.get(spec[0])
        if value is None:
            continue
        if spec[1] == "int":
            out += field(no, 0, number(value))
        elif spec[1] == "doubles":
            out += b"".join(field(no, 1, struct.pack("<d", x)) for x in value)
        else:
            for item in value if spec[1] == "list" else [value]:
                body = message(spec[2], item)
                out += field(no, 2, number(len(body)) + body)
    return out


def frame(meter, samples):
    body = b"".join(field(1, 2, number(len(m)) + m) for m in (message(framed.METERS[meter], s) for s in samples))
    return len(body).to_bytes(8, "little") + body


SECOND = 1_000_000_000


@pytest.fixture()
def run_dir(tmp_path):
    run = tmp_path / "2025-10-18T18:43:27-0500"
    run.mkdir()
    cpu = [
        {"timestamp": t * SECOND, "core_stats": [{"user": 10 * t, "idle": 30 * t, "system": 0}, {"user": 1}]}
        for t in range(5)
    ]
    (run / "CPUMeter.pb.bin").write_bytes(frame("cpu", cpu[:2]) + frame("cpu", cpu[2:]))
    disk = [{"timestamp": t * SECOND, "disk_metrics": [{"sectors_read": 2048 * t, "sectors_written": 0}, {"sectors_read": 0, "sectors_written": 0}]} for t in range(3)]
    (run / "DiskMeter.pb.bin").write_bytes(frame("disk", disk))
    gpu = [{"timestamp": t, "per_gpu_metrics": [{"gpm_metrics_values": [1.5, 2.5], "per_process_gpu_metrics": [{"pid": 1, "used_gpu_memory": 1 << 30}]}, {}]} for t in range(2)]
    (run / "GPUMeter.pb.bin").write_bytes(frame("gpu", gpu))
    mem = [{"meminfo_metrics": {"basic_metrics": {"mem_free": 1 << 20}, "kernel_cache_metrics": {"cached": 1 << 21}}} for _ in range(3)]
    (run / "MemMeter.pb.bin").write_bytes(frame("mem", mem))
    proc = [{"per_proc_metrics": [{"pid_stat_metrics": {"state": 83, "nice": -5}}]}]
    (run / "ProcMeter.pb.bin").write_bytes(frame("proc", proc) + (0).to_bytes(8, "little"))
    (run / "time_break_down.txt").write_text("start, 0\nnot a mark\nembed, 1000000000\nfree models, 3000000000\n,\ndone,4000000000 \n")
    return tmp_path


def test_all_meters(spark, run_dir):
    counts = {m: framed.read_metrics(spark, str(run_dir), m).count() for m in framed.METERS}
    assert counts == {"cpu": 5, "disk": 3, "gpu": 2, "mem": 3, "proc": 1}
    proc = framed.read_metrics(spark, str(run_dir), "proc").first()
    assert proc.timestamp is None and proc.per_proc_metrics[0].pid_stat_metrics.nice == -5
    assert proc.per_proc_metrics[0].pid_io_metrics is None
    cpu = framed.read_metrics(spark, str(run_dir), "cpu").orderBy("sample_idx").collect()
    assert [r.timestamp for r in cpu] == [t * SECOND for t in range(5)]
    assert len(cpu[0].core_stats) == 2 and cpu[4].core_stats[0].idle == 120
    with pytest.raises(ValueError):
        framed.read_metrics(spark, str(run_dir), "fan")


@pytest.mark.parametrize("bad", [b"\x05\x00\x00", (100).to_bytes(8, "little") + b"abc"])
def test_cut_off_files_raise(spark, tmp_path, bad):
    good = frame("cpu", [{"timestamp": 1}])
    (tmp_path / "CPUMeter.pb.bin").write_bytes(good + bad)
    with pytest.raises(Exception, match="file ends inside|expected a message"):
        framed.read_metrics(spark, str(tmp_path), "cpu").collect()


def test_empty_file_and_no_file(spark, tmp_path):
    (tmp_path / "CPUMeter.pb.bin").write_bytes(b"")
    assert framed.read_metrics(spark, str(tmp_path), "cpu").count() == 0
    assert framed.read_metrics(spark, str(tmp_path), "gpu").count() == 0


def test_run_report(spark, run_dir):
    path = str(run_dir)
    shares = run_report.cpu_shares(spark, path).orderBy("ts_ns").collect()
    assert [(r.seconds, r.share_user, r.share_idle) for r in shares] == [(float(t), None, None) for t in range(4)]
    rates = run_report.disk_bandwidth(spark, path).orderBy("disk", "ts_ns").collect()
    assert [r.mb_s_sectors_read for r in rates] == [0.0, 1.0, 1.0, 0.0, 0.0, 0.0]
    assert [r.used_gib for r in run_report.gpu_memory(spark, path).orderBy("ts_ns", "gpu").collect()] == [1.0, 0.0, 1.0, 0.0]
    memory = run_report.memory(spark, path).orderBy("sample_idx").collect()
    assert [(r.seconds, r.free_gib, r.available_gib, r.cached_gib) for r in memory] == [
        (pytest.approx(i / 10), 1.0, None, 2.0) for i in range(3)
    ]
    probes = framed.probe_groups(framed.read_metrics(spark, path, "mem"), "meminfo_metrics", ["basic_metrics"])
    assert probes.columns == ["run", "sample_idx", "basic_metrics"] and probes.first().basic_metrics.mem_free == 1 << 20
    with pytest.raises(ValueError, match="unknown probes"):
        framed.probe_groups(framed.read_metrics(spark, path, "mem"), "meminfo_metrics", ["fans"])
    stages = run_report.stages(spark, path).orderBy("ts_ns").collect()
    assert [(r.tag, r.duration) for r in stages] == [
        ("start", SECOND), ("embed", 2 * SECOND), ("free models", SECOND), ("done", None)
    ]
    by_stage = run_report.cpu_by_stage(spark, path).orderBy("stage").collect()
    assert [(r.stage, r.n_samples) for r in by_stage] == [("done", 1), ("embed", 2), ("free models", 1)]
    names = framed.gpm_names(spark, [2, 3])
    values = run_report.gpu_values(spark, path).join(names, "position")
    assert {r.metric for r in values.collect()} == {"GPM_SM_UTIL", "GPM_SM_OCCUPANCY"}


def test_missing_counters_count_as_zero_in_shares(spark, run_dir):
    """Only reported states take part in a share."""
    from vektorloom.operators.telemetry import counter_deltas, state_shares

    samples = framed.cpu_total(framed.read_metrics(spark, str(run_dir), "cpu"))
    states = ["user", "system", "idle"]
    got = state_shares(counter_deltas(samples, ["run"], ["ts_ns"], states), states).collect()
    assert [(r.share_user, r.share_system, r.share_idle) for r in got] == [(25.0, 0.0, 75.0)] * 4


def test_run_folders(spark, tmp_path):
    names = ["2025-10-18T18:43:27-0500", "2025-10-18T20:00:00+0000", "notes"]
    for name in names:
        (tmp_path / name).mkdir()
        (tmp_path / name / "CPUMeter.pb.bin").write_bytes(b"x")
    found = files.list_files(spark, str(tmp_path), "*.pb.bin")
    assert [r.folder for r in files.runs_by_age(found).collect()] == names[:2]
    assert files.latest_run(found).first().folder == names[0]
    kinds = spark.createDataFrame([("CPUMeter.pb.bin",), ("MemMeter_1.pb.bin",), ("x.txt",)], "name string")
    assert [r[0] for r in kinds.select(files.meter_of(F.col("name"))).collect()] == ["cpu", "mem", None]


def test_token_logs(spark, tmp_path):
    (tmp_path / "wiki_batch_64.log").write_text("x Max Token Size in Batch: 12\nnoise\nMax Token Size in Batch: 12\nMax Token Size in Batch: 7\n")
    (tmp_path / "wiki_batch_8.log").write_text("Max Token Size in Batch: 3\n")
    (tmp_path / "other.log").write_text("Max Token Size in Batch: 3\n")
    histogram = logs.token_histogram(logs.read_token_sizes(spark, str(tmp_path)))
    assert sorted(tuple(r) for r in histogram.collect()) == [(8, 3, 1), (64, 7, 1), (64, 12, 2)]
    logs.write_token_histogram(histogram, str(tmp_path / "out"))
    written = list((tmp_path / "out" / "batch=64").glob("*.csv"))
    assert len(written) == 1 and written[0].read_text() == "7,1\n12,2\n"


def test_listings_and_pages(spark, tmp_path):
    for name in ("b.pdf", "a.pdf", "c.txt"):
        (tmp_path / name).write_bytes(name.encode())
    assert [r.name for r in files.list_pdfs(spark, str(tmp_path)).collect()] == ["a.pdf", "b.pdf"]
    pdfs = tables.read_tagged(spark, str(tmp_path), "pdf")
    parser = lambda: lambda data: [
        {"page": 1, "kind": "text", "text": bytes(data).decode()},
        {"page": 1, "kind": "figure", "data": b"\x00"},
    ]
    parsed = documents.parse_pages(pdfs, parser).orderBy("path", "item_idx").collect()
    assert [(r.kind, r.text) for r in parsed] == [("text", "a.pdf"), ("figure", None), ("text", "b.pdf"), ("figure", None)]
    ids = pdfs.select(documents.document_key(F.col("path")).alias("k")).distinct()
    assert ids.count() == 2
    with pytest.raises(ValueError):
        tables.read_tagged(spark, str(tmp_path), "odt")


def test_html_blocks(spark):
    html = (
        "<title>T</title><script>var x='<p>no</p>'</script><h1>A</h1><p>one<br>two &amp; three</p>"
        "<h2>B</h2><ul><li>x</li><li>y</li></ul><h1>C</h1>tail<style>p{}</style>"
    )
    df = spark.createDataFrame([(1, html), (2, None)], "doc_id long, html string")
    got = documents.parse_documents(df, "doc_id", "html").orderBy("block_idx").collect()
    assert [(r.kind, r.heading_path, r.text) for r in got] == [
        ("title", [], "T"),
        ("heading", [], "A"),
        ("paragraph", ["A"], "one two & three"),
        ("heading", ["A"], "B"),
        ("list_item", ["A", "B"], "x"),
        ("list_item", ["A", "B"], "y"),
        ("heading", [], "C"),
        ("text", ["C"], "tail"),
    ]


def test_pages_and_shares(spark):
    df = spark.range(0, 95).withColumn("k", F.col("id") * 7).repartition(4)
    assert sorted(r.id for r in tables.corpus_page(df, "k", 20, 2).collect()) == list(range(40, 60))
    assert sorted(r.id for r in tables.corpus_page(df, "k", 20, 4).collect()) == list(range(80, 95))
    assert sorted(r.id for r in tables.corpus_share(df, "k", 0.5).collect()) == list(range(47))
    assert tables.corpus_share(df, "k", 1.0).count() == 95
    assert tables.corpus_share(df, "k", 0.001).count() == 0
    with pytest.raises(ValueError):
        tables.corpus_page(df, "k", 20, 5)


def test_pages_with_equal_and_null_keys(spark):
    df = spark.range(0, 30).withColumn("k", F.when(F.col("id") >= 3, F.col("id") % 4)).repartition(3)
    pages = [[r.id for r in tables.corpus_page(df, "k", 10, n).collect()] for n in range(3)]
    assert [len(p) for p in pages] == [10, 10, 10] and sorted(sum(pages, [])) == list(range(30))
    assert {0, 1, 2} <= set(pages[0])
    twice = df.unionByName(df)
    assert tables.corpus_page(twice, "k", 7, 2).count() == 7


def test_row_index(spark):
    df = spark.range(0, 1000).select((F.col("id") * 37 % 1000).alias("k"), F.col("id").alias("v")).repartition(9)
    got = ranking.with_row_index(df, ["k"]).collect()
    assert all(r.k == r.row_idx for r in got) and len(got) == 1000


def test_text_expressions(spark):
    df = spark.createDataFrame([("/data/x/paper.v1.pdf", "wiki/20231101.en é!", "a\n\n\nb\nc")], "path string, name string, t string")
    row = df.select(
        tx.base_name(F.col("path")),
        tx.stem(F.col("path")),
        tx.extension(F.col("path")),
        tx.directory_name(F.col("path")),
        tx.collection_name(F.col("name")),
        tx.collapse_newlines(F.col("t")),
        tx.format_context(F.lit(0), F.col("t")),
        tx.nested_value(F.lit('{"a": [{"b": 5}]}'), "a.0.b"),
        tx.captured_int(F.lit("none"), r"(\d+)"),
    ).first()
    assert tuple(row) == (
        "paper.v1.pdf", "paper.v1", ".pdf", "/data/x", "wiki_20231101_en_é_", "a\nb\nc",
        "Source #0\nDetail: a\n\n\nb\nc\n", "5", None,
    )


def test_clocks_ignore_the_session_zone(spark):
    df = spark.createDataFrame([("2025-10-18T18:43:27-0500", "2024-03-10 02:30:00.123456")], "folder string, at string")
    timed = df.select(F.unix_seconds(run_started_at(F.col("folder"))), epoch_us(F.col("at").cast("timestamp_ntz")))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert tuple(timed.first()) == (1760831007, 1710037800123456)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_sinks(spark, tmp_path):
    scores = spark.createDataFrame([("q, 1", ["a", "b"], 0.5)], "user_input string, contexts array<string>, recall double")
    tables.write_scores(scores, str(tmp_path / "scores"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "scores")).first()
    assert tuple(back) == ("q, 1", '["a","b"]', "0.5")
    stats = spark.createDataFrame([(0, 1, 2, None, 4, 5)], "round int, embedding long, retrieval long, rerank long, prompt long, generation long")
    for _ in range(2):
        tables.append_round_stats(stats, str(tmp_path / "stats"))
    lines = spark.read.text(str(tmp_path / "stats")).collect()
    assert [r.value for r in lines] == ["0\t1\t2\t0\t4\t5\t12"] * 2
    vectors = spark.createDataFrame([(1, [1.0])], "id long, vector array<float>")
    tables.write_embeddings(vectors, str(tmp_path / "vectors"))
    assert tables.read_embeddings(spark, str(tmp_path / "vectors")).collect() == vectors.collect()


@pytest.mark.parametrize("of", ["k", "name"])
def test_positions_against_a_sort(spark, of):
    """Any range of positions, also one that begins or ends among repeated rows or NULL keys."""
    rows = [(None if i % 11 == 0 else i % 7, None if i % 5 == 0 else f"n{i % 3}", i % 2) for i in range(60)] * 2
    df = spark.createDataFrame(rows, "k long, name string, v long").repartition(5)
    order = ranking.Positions(df, of)
    tied = df.withColumn("_tie", F.xxhash64(*df.columns)).orderBy(of, "_tie").drop("_tie").collect()
    for start, stop in [(0, 1), (0, 120), (3, 4), (5, 41), (17, 90), (21, 22), (119, 500), (50, 50), (200, 300)]:
        assert sorted(map(str, order.rows(start, stop).collect())) == sorted(map(str, tied[start:stop])), (start, stop)


def test_pages_move_keys_only(spark, tmp_path):
    spark.range(0, 5000).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 50).alias("body")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    found = ranking.page(df, "k", 100, 7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "GreaterThanOrEqual(k,700)" in plan and "LessThanOrEqual(k,799)" in plan
    assert [r.k for r in found.orderBy("k").collect()] == list(range(700, 800))


def test_metadata_messages():
    from vektorloom.sources import messages

    gpu = message({1: ("dev_id", "text")}, {}) + field(1, 2, number(5) + b"GPU-0") + field(3, 0, number(2)) + field(3, 2, number(2) + b"\x03\x0a")
    gpu += field(4, 2, number(4) + field(1, 2, number(2) + b"H1"))
    row = messages.decode_message(gpu, messages.METADATA["gpu"])
    assert (row["dev_id"], row["gpm_metrics"], row["properties"]["dev_name"]) == ("GPU-0", [2, 3, 10], "H1")
    assert messages.spark_fields(messages.METADATA["proc"]).simpleString() == "struct<proc_meta:array<struct<proc_name:string,pid:bigint,probes:array<bigint>>>>"
    assert len(messages.GPM_NAMES) == 71 and messages.GPM_NAMES[97] == "GPM_NVLINK_L17_TX_PER_SEC"


def test_bytes_survive_the_line_reader(spark, tmp_path):
    """Line ends, carriage returns, broken UTF-8, splits inside messages, and files that look like other things."""
    import random

    pick = random.Random(3)
    bodies = {
        "a": [bytes(pick.choice(b"\n\r\x00\xff\xc3az") for _ in range(pick.randrange(3000))) for _ in range(40)],
        "b": [b"", b"\n", b"", b"\n\n\r\n", b"x"],
        "c": [b"z" * (0xBFBBEF - 6) + b"\nright"],  # its length begins like a byte order mark
        "d": [],
        "e": [b"", b""],
    }
    (tmp_path / "r u:n").mkdir()
    for name, parts in bodies.items():
        data = b"".join(len(x).to_bytes(8, "little") + x for x in parts)
        (tmp_path / "r u:n" / f"CPUMeter_{name}.pb.bin").write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        frames = framed.read_frames(spark, str(tmp_path), "CPUMeter*.pb.bin")
        got = {}
        for r in frames.select("path", "frame", "body").collect():
            got.setdefault(r.path[-8], {})[r.frame] = bytes(r.body)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {n: [f[i] for i in range(len(f))] for n, f in got.items()} == {n: x for n, x in bodies.items() if x}


def test_one_large_file_is_decoded_by_many_tasks(spark, tmp_path):
    samples = [{"timestamp": t, "core_stats": [{"user": t}]} for t in range(4000)]
    (tmp_path / "CPUMeter.pb.bin").write_bytes(b"".join(frame("cpu", samples[i : i + 50]) for i in range(0, 4000, 50)))
    rows = framed.read_metrics(spark, str(tmp_path), "cpu").withColumn("task", F.spark_partition_id())
    assert rows.select("task").distinct().count() > 8
    assert [r.timestamp for r in rows.orderBy("sample_idx").collect()] == list(range(4000))


def test_probe_groups_are_pushed_into_the_decoder(spark, run_dir):
    some = framed.read_metrics(spark, str(run_dir), "mem", "meminfo_metrics", ["basic_metrics"])
    assert some.schema["meminfo_metrics"].dataType.names == ["basic_metrics"]
    assert [r.meminfo_metrics.basic_metrics.mem_free for r in some.collect()] == [1 << 20] * 3
    with pytest.raises(ValueError, match="unknown probes"):
        framed.read_metrics(spark, str(run_dir), "mem", "meminfo_metrics", ["fans"])


def test_device_names(spark, tmp_path):
    run = tmp_path / "2025-10-18T18:43:27-0500"
    run.mkdir()
    meta = b"".join(field(1, 2, number(len(m)) + m) for m in (field(1, 2, number(len(n)) + n) for n in (b"sda", b"nvme0")))
    (run / "DiskMeter_meta.pb.bin").write_bytes(len(meta).to_bytes(8, "little") + meta)
    found = framed.read_metadata(spark, str(tmp_path), "disk", "*_meta.pb.bin").first()
    assert [d.dev_name for d in found.disk_meta] == ["sda", "nvme0"] and found.run == run.name


def test_all_meters_by_stage(spark, run_dir):
    run = next(run_dir.iterdir())
    proc = [{"timestamp": t * SECOND, "per_proc_metrics": [{"pid_stat_metrics": {"utime": 50 * t, "stime": 0}, "pid_statm_metrics": {"resident": 1 << 18}, "pid_io_metrics": {"read_bytes": t << 20, "write_bytes": 0}}]} for t in range(5)]
    (run / "ProcMeter.pb.bin").write_bytes(frame("proc", proc))
    mem = [{"timestamp": t * SECOND, "meminfo_metrics": {"basic_metrics": {"mem_free": (t + 1) << 20}}} for t in range(5)]
    (run / "MemMeter.pb.bin").write_bytes(frame("mem", mem + [{"meminfo_metrics": {}}]))
    got = {(r.stage, r.meter, r.device, r.measure): (r["mean"], r.peak, r.n_samples) for r in run_report.usage_by_stage(spark, str(run_dir)).collect()}
    assert got[("embed", "disk", 0, "mb_s_sectors_read")] == (1.0, 1.0, 2)
    assert got[("embed", "proc", 0, "cpu_percent")] == (50.0, 50.0, 2) and got[("start", "proc", 0, "cpu_percent")] == (None, None, 0)
    assert got[("embed", "proc", 0, "resident_gib")] == (1.0, 1.0, 2) and got[("embed", "proc", 0, "mb_s_read")] == (1.0, 1.0, 2)
    assert got[("embed", "mem", None, "free_gib")] == (2.5, 3.0, 2) and got[("done", "mem", None, "free_gib")] == (5.0, 5.0, 1)
    assert got[("start", "gpu", 0, "gpm_1")] == (2.5, 2.5, 2) and ("start", "gpu", 1, "used_gib") in got


def test_names_from_metadata(spark, tmp_path):
    run = tmp_path / "2025-10-18T18:43:27-0500"
    run.mkdir()
    text = lambda no, value: field(no, 2, number(len(value)) + value)
    proc = text(1, text(1, b"server") + field(2, 0, number(77)) + field(3, 0, number(1)))
    gpu = text(1, b"GPU-0") + field(3, 2, number(2) + b"\x02\x63")
    for name, body in (("ProcMeterMeta", proc), ("GPUMeterMeta", gpu)):
        (run / f"{name}.pb.bin").write_bytes(len(body).to_bytes(8, "little") + body)
    found = run_report.process_names(spark, str(tmp_path), "ProcMeterMeta*").collect()
    assert [tuple(r) for r in found] == [(run.name, 0, 77, "server")]
    metrics = run_report.gpu_metric_names(spark, str(tmp_path), "GPUMeterMeta*").orderBy("position").collect()
    assert [(r.position, r.metric) for r in metrics] == [(0, "GPM_SM_UTIL"), (1, "GPM_99")]


def test_blocks_of_few_documents_are_held_at_once(spark):
    """What a parser has made of earlier documents goes before the next slice is parsed."""

    def counting():
        import weakref

        class Blocks(list):
            pass

        made = []

        def parse(content):
            blocks = Blocks([{"kind": "text", "heading_path": [], "text": str(sum(r() is not None for r in made))}])
            made.append(weakref.ref(blocks))
            return blocks

        return parse

    df = spark.range(12).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 1 << 20).alias("html")).coalesce(1)
    got = documents.parse_documents(df, "doc_id", "html", counting).collect()
    assert len(got) == 12 and max(int(r.text) for r in got) <= 8


def test_documents_without_key_or_content(spark):
    df = spark.createDataFrame([(1, "<p>a"), (None, "<p>b"), (3, None), (4, "")], "doc_id long, html string")
    got = documents.parse_documents(df, "doc_id", "html").collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "b"), (1, "a")]
    raw = df.select("doc_id", F.col("html").cast("binary").alias("html"))
    assert sorted((r.doc_id or 0, r.text) for r in documents.parse_documents(raw, "doc_id", "html").collect()) == [(0, "b"), (1, "a")]
