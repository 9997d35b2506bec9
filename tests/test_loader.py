"""Batches, micro-batches, manifests and settings."""

import json

import random

import pytest

from quarry.functions.quality import Limits
from quarry.operators import loader, runs
from quarry.plans import clean
from quarry.sources import manifests, records, token_files


def test_batches(spark):
    ids = spark.range(21).withColumnRenamed("id", "block_id")
    one = loader.batches(ids, "block_id", 4, 5, epoch=0)
    rows = one.collect()
    assert len(rows) == 20 and {(r.batch_id, r.slot) for r in rows} == {(b, s) for b in range(5) for s in range(4)}
    assert rows_of(one) == rows_of(loader.batches(ids.repartition(7), "block_id", 4, 5, epoch=0)) != rows_of(loader.batches(ids, "block_id", 4, 5, epoch=1))
    plain = [r.block_id for r in loader.iterate(loader.batches(ids, "block_id", 4, 5, shuffle=False, drop_last=False))]
    assert plain == list(range(21))
    micro = loader.micro_batches(one, 3).collect()
    assert {(r.slot // 3, r.share) for r in micro} == {(0, 0.75), (1, 0.25)}


def rows_of(df):
    return sorted((r.block_id, r.batch_id, r.slot) for r in df.collect())


def test_json_documents(spark, tmp_path):
    (tmp_path / "sweep.json").write_text(json.dumps({"factor_keys": {"layers": "n_layer"}, "runs": [{"name": "a", "factor": "layers", "overrides": {"n_layer": 1}, "summary": {"steps": 3, "final_val_loss": 2.5}}]}, indent=1))
    (tmp_path / "summary.json").write_text(json.dumps({"name": "a", "epochs": [{"epoch": 1, "val_loss": 2.0}, {"epoch": 2, "val_loss": 1.0}]}, indent=1))
    (tmp_path / "samples.json").write_text(json.dumps({"run": "a", "samples": [{"prompt": "p", "completion": "c"}]}, indent=1))
    run = manifests.sweep_runs(spark, str(tmp_path / "sweep.json")).first()
    assert (run.name, run.overrides, run.steps, run.final_val_loss) == ("a", {"n_layer": 1.0}, 3, 2.5)
    assert [r.val_loss for r in manifests.epochs(manifests.summaries(spark, str(tmp_path / "summary.json"))).collect()] == [2.0, 1.0]
    assert manifests.samples(spark, str(tmp_path / "samples.json")).first() == ("a", "p", "c")


def test_settings(monkeypatch):
    monkeypatch.setenv("QUARRY_B", "env")
    assert manifests.settings("# no\n\nexport QUARRY_A='x y'\nQUARRY_B=file\nQUARRY_C = \"q\"\nnothing") == {"QUARRY_A": "x y", "QUARRY_B": "env", "QUARRY_C": "q"}


def test_shuffle_buffer(spark):
    ids = spark.range(200).withColumnRenamed("id", "block_id")
    got = loader.buffered_shuffle(ids.repartition(7), "block_id", 10, 3, workers=4).collect()
    assert got == loader.buffered_shuffle(ids, "block_id", 10, 3, workers=4).collect()
    for w in range(4):
        order = [r.block_id for r in sorted((r for r in got if r.worker == w), key=lambda r: r.place)]
        own = list(range(w, 200, 4))
        assert sorted(order) == own and order != own
        # none comes before the buffer has got to it
        assert all(own.index(x) < k + 10 for k, x in enumerate(order))
    assert loader.buffered_shuffle(ids.limit(0), "block_id", 10, 3).count() == 0


def test_checked_settings():
    good = {"seq_len": 128, "n_embd": 128, "n_head": 4, "batch_size": 32, "micro_batch": 16, "vocab_size": 50_257, "dtype": "uint16"}
    assert manifests.checked(good) == good
    for bad in ({"seq_len": 100}, {"n_embd": 130}, {"batch_size": 33}, {"vocab_size": 70_000}, {"dtype": "int32"}):
        with pytest.raises(ValueError, match=next(iter(bad))):
            manifests.checked({**good, **bad})


def test_settings_from_flags():
    limits = manifests.from_args(Limits, ["--min_words", "40", "--max_mean", "12.5"])
    assert (limits.min_words, limits.max_mean, limits.min_mean) == (40, 12.5, 2.0)


def test_token_files(spark, tmp_path):
    blocks = spark.createDataFrame([(s, i, [(i * 7 + k) % 65_536 for k in range(4)]) for s in ("train", "val") for i in range(11 if s == "train" else 2)], "split string, block_id bigint, tokens array<int>")
    done = token_files.write_blocks(blocks.repartition(3), str(tmp_path / "t"), 4, per_file=4)
    assert sorted((r.path.rsplit("/")[-1], r.n_blocks, r.n_bytes) for r in done.collect()) == [("train-00000.bin", 4, 32), ("train-00001.bin", 4, 32), ("train-00002.bin", 3, 24), ("val-00000.bin", 2, 16)]
    back = token_files.read_blocks(spark, str(tmp_path / "t"), 4, per_file=4)
    assert sorted(back.collect()) == sorted(blocks.collect()) and not list((tmp_path / "t").glob("*.part"))
    with pytest.raises(Exception, match="16 bits"):
        token_files.write_blocks(spark.createDataFrame([("val", 0, [70_000])], blocks.schema), str(tmp_path / "u"), 1)


def test_manifest_documents(spark, tmp_path):
    sources = spark.createDataFrame([("b", 2, 20), ("a", 1, 10)], "source string, documents bigint, text_bytes bigint")
    files = spark.createDataFrame([("f0", 7, "x")], "path string, n_bytes bigint, sha256 string")
    made = manifests.collection_manifest(spark, sources, files, {"seed": 1, "out": "d"}, "2026-01-01T00:00:00+00:00")
    read = json.loads(made.first().manifest)
    assert list(read) == ["stage", "started_utc", "finished_utc", "args", "sources", "shards", "totals"]
    assert [s["source"] for s in read["sources"]] == ["a", "b"] and read["totals"] == {"documents": 3, "text_bytes": 30, "shards": 1, "compressed_bytes": 7}
    nothing = json.loads(manifests.collection_manifest(spark, sources.limit(0), files.limit(0), {"seed": 1}, "t").first().manifest)
    assert nothing["sources"] == [] and nothing["totals"] == {"documents": 0, "text_bytes": 0, "shards": 0, "compressed_bytes": 0}
    manifests.write_document(sources.where("source = 'a'"), str(tmp_path / "one"))
    assert manifests.document(spark, str(tmp_path / "one")).first().documents == 1


def test_progress_is_observed(spark):
    judged, seen = clean.observed(clean.judged(records.documents(spark, "/root/testdata/sf0.001")))
    judged.write.format("noop").mode("overwrite").save()
    assert seen.get["documents"] == 200 and 0 < seen.get["kept"] < 200


def test_log_goes_on(spark, tmp_path):
    path = str(tmp_path / "log")
    step = lambda r, k: (r, "step", k)
    schema = "run string, kind string, step bigint"
    runs.append_log(spark.createDataFrame([step("a", k) for k in range(1, 9)] + [step("b", 1)], schema), path)
    runs.resume_log(spark, path, spark.createDataFrame([("a", 5)], "run string, checkpoint bigint"))
    runs.append_log(spark.createDataFrame([step("a", 6)], schema), path)
    assert sorted((r.run, r.step) for r in runs.read_log(spark, path).collect()) == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("a", 5), ("a", 6), ("b", 1)]


def test_log_is_never_half_written(spark, tmp_path, monkeypatch):
    """Stopped between writing what is kept and pointing at it, or in the middle of an append, the log is what it was."""
    path = str(tmp_path / "log")
    rows = lambda *steps: spark.createDataFrame([("a", "step", k) for k in steps], "run string, kind string, step bigint")
    at = spark.createDataFrame([("a", 2)], "run string, checkpoint bigint")
    said = lambda: sorted(r.step for r in runs.read_log(spark, path).collect())
    assert said() == []
    runs.append_log(rows(1, 2, 3), path)
    runs.append_log(rows(4), path)
    with monkeypatch.context() as m:
        m.setattr(runs, "_point", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        for stopped in (lambda: runs.resume_log(spark, path, at), lambda: runs.append_log(rows(9), path)):
            with pytest.raises(KeyboardInterrupt):
                stopped()
            assert said() == [1, 2, 3, 4]
    runs.resume_log(spark, path, at)
    assert said() == [1, 2]
    runs.append_log(rows(3), path)
    # what was left behind is gone
    assert said() == [1, 2, 3] and len(runs.segments(spark, path)) == 2 and sum(p.name.startswith("segment") for p in (tmp_path / "log").iterdir()) == 2


def test_files_begin_where_the_last_one_is_full(spark):
    """Against the rule followed record by record: records larger than a file, than a range, and small ranges and trees."""
    from quarry.sources.rotation import first_records

    rng = random.Random(6)
    for files, fan, big in ((64, 16, 30), (2, 2, 30), (2, 3, 900), (3, 2, 5000)):
        sizes = [rng.choice([1, 2, 7, big]) if rng.random() < 0.1 else rng.randint(1, 20) for _ in range(400)]
        want, filled = [], 10**9
        for k, n in enumerate(sizes):
            if filled >= 100:
                want.append(7 * k)
                filled = 0
            filled += n
        df = spark.createDataFrame([(7 * k, n) for k, n in enumerate(sizes)], "seq bigint, size bigint").repartition(3)
        assert first_records(df, 100, files, fan) == want, (files, fan, big)
    assert first_records(df.limit(0), 100) == []


def test_pinned_source(spark, tmp_path):
    """Columns asked for alone; rows after those read; a reader that fails midway; a file that isn't what was pinned."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from quarry.sources import snapshots

    paths = []
    for k in range(3):
        rows = range(10_000 * k, 10_000 * k + 9000)
        pq.write_table(pa.table({"text": [f"t{i}" for i in rows], "doc_id": list(rows), "gone": [None] * 9000}), f"{tmp_path}/{k}.parquet", row_group_size=2500)
        paths.append(f"file://{tmp_path}/{k}.parquet")
    folder = f"file://{tmp_path}/pins"
    revision = snapshots.pin(spark, paths, folder, "src")
    assert snapshots.pin(spark, paths[::-1], folder, "src") == revision
    whole = snapshots.select(spark, folder, "src", revision)
    assert whole.columns == ["text", "doc_id", "gone"] and whole.count() == 27_000 and whole.rdd.getNumPartitions() == 3
    for skip, fail_after in ((0, 5000), (2500, 1), (8999, 0), (5100, 3000), (9000, 0)):
        drill = f"file://{tmp_path}/failed-{skip}"
        got = snapshots.select(spark, folder, "src", revision, ["doc_id", "text"], skip=skip, drill=drill, fail_after=fail_after)
        rows = [tuple(r) for r in got.collect()]
        assert sorted(rows) == [(i, f"t{i}") for k in range(3) for i in range(10_000 * k + skip, 10_000 * k + 9000)]
        assert (tmp_path / f"failed-{skip}").exists() == (skip < 9000)
    with pytest.raises(Exception, match="drill"):
        snapshots.select(spark, folder, "src", revision, ["doc_id"], retries=-1, drill=f"file://{tmp_path}/again", fail_after=10).count()
    pq.write_table(pa.table({"text": ["x"], "doc_id": [1], "gone": [None]}), f"{tmp_path}/1.parquet")
    with pytest.raises(Exception, match="isn't what was pinned"):
        snapshots.select(spark, folder, "src", revision, ["doc_id"]).collect()


def test_digest_of_a_long_file(spark, tmp_path):
    """3 GB of zeros (which take no disk) are read in ranges of bytes; short files as before."""
    import hashlib

    with open(tmp_path / "long", "wb") as f:
        f.truncate(3 << 30)
    (tmp_path / "short").write_bytes(b"abc")
    got = {r.path.rsplit("/", 1)[1]: (r.n_bytes, r.sha256) for r in records.digests(spark, str(tmp_path)).collect()}
    zeros, sha = bytes(1 << 24), hashlib.sha256()
    for _ in range(192):
        sha.update(zeros)
    assert got == {"long": (3 << 30, sha.hexdigest()), "short": (3, hashlib.sha256(b"abc").hexdigest())}
