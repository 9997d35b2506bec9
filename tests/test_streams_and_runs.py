"""Sampling, packing, run logs, sweeps, sampling math and streaming."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import schedule
from quarry.operators import bpe, packing, runs, sampling, sampling_math, sweep
from quarry.operators.dedup import mark_first
from quarry.operators.prefix import affine_scan, numbered, running_sum
from quarry.streaming import dedup


def test_running_sum(spark):
    rng = random.Random(1)
    rows = [(k * 3, rng.choice("ab"), rng.randint(0, 9)) for k in range(300)]
    got = running_sum(spark.createDataFrame(rows, "seq bigint, g string, v bigint"), "v", "seq", "at", ["g"], span=16).collect()
    for r in got:
        assert r["at"] == sum(v for s, g, v in rows if g == r.g and s < r.seq)


def docs(spark, n=60, seed=2):
    rng = random.Random(seed)
    return [(k, rng.choice(["train", "train", "val"]), [rng.randint(0, 99) for _ in range(rng.choice([0, 1, 5, 30, 8]))]) for k in range(n)]


@pytest.mark.parametrize("block", [1, 8, 500])
def test_pack(spark, block):
    rows = docs(spark)
    got = packing.pack(spark.createDataFrame(rows, "seq bigint, split string, tokens array<int>"), block).collect()
    for split in ("train", "val"):
        flat = [t for _, s, ts in rows if s == split for t in ts]
        want = [flat[k : k + block] for k in range(0, len(flat) // block * block, block)]
        assert [r.tokens for r in sorted(got, key=lambda r: r.block_id) if r.split == split] == want


def test_pairs_and_windows(spark):
    blocks = packing.pack(spark.createDataFrame([(0, "train", list(range(70)))], "seq bigint, split string, tokens array<int>"), 16, ahead=1)
    pairs = {r.block_id: r for r in packing.pairs(blocks, 16).collect()}
    assert sorted(pairs) == [0, 1, 2] and all(r.label == [t + 1 for t in r.input] for r in pairs.values())
    one = packing.pairs(blocks, 16)
    assert packing.pair_at(one, 0) == packing.pair_at(one, -3) and packing.pair_at(one, -1).input[0] == 32
    for far in (3, -4):
        with pytest.raises(IndexError):
            packing.pair_at(one, far)
    seen = []
    for length in (4, 8, 16):
        w = packing.windows(blocks, length, 16).collect()
        assert all(r.label == [t + 1 for t in r.input] for r in w)
        seen.append(sorted(t for r in w for t in r.input))
    assert seen[0] == seen[1] == seen[2] == list(range(48))
    with pytest.raises(ValueError):
        packing.windows(blocks, 5, 16)


@pytest.mark.parametrize("block", [1, 8, 30])
def test_pack_ahead(spark, block):
    rows = docs(spark, seed=9)
    got = packing.pack(spark.createDataFrame(rows, "seq bigint, split string, tokens array<int>"), block, ahead=1).collect()
    for split in ("train", "val"):
        flat = [t for _, s, ts in rows if s == split for t in ts]
        want = [flat[k : k + block + 1] for k in range(0, (len(flat) // block - 1) * block, block)]
        assert [r.tokens for r in sorted(got, key=lambda r: r.block_id) if r.split == split] == want


def test_numbered(spark):
    df = spark.createDataFrame([(k * 7 % 101, "x" * (k % 3)) for k in range(101)], "v bigint, t string").repartition(5)
    got = numbered(df, ["t", "v"], "n").collect()
    assert [(r.t, r.v) for r in sorted(got, key=lambda r: r.n)] == sorted((r.t, r.v) for r in df.collect()) and sorted(r.n for r in got) == list(range(101))
    assert numbered(df.limit(0), ["v"], "n").count() == 0


def shuffled_bytes(spark, action):
    """Bytes that the stages of an action write for others to read."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (found.apply(k) for k in range(found.size()))}

    before = stages()
    action()
    return sum(n for k, n in stages().items() if k not in before)


def test_blocks_are_cut_where_documents_lie(spark):
    """Of documents whose partitions are ranges, less than a twentieth of the tokens is shuffled: edges of blocks alone."""
    ids = F.transform(F.sequence(F.lit(1), F.lit(500)), lambda k: F.pmod(F.hash(F.col("id"), k), F.lit(65_000)))
    docs = spark.range(0, 12_000, 1, 4).select(F.col("id").alias("seq"), F.when(F.col("id") % 10 == 0, "val").otherwise("train").alias("split"), ids.alias("tokens"))
    count = []
    moved = shuffled_bytes(spark, lambda: count.append(packing.pack(docs).count()))
    assert count[0] == 5_400_000 // 1024 + 600_000 // 1024
    assert 0 < moved < 0.05 * 2 * 6_000_000
    mixed = packing.pack(docs.repartition(4))
    assert mixed.exceptAll(packing.pack(docs)).isEmpty() and mixed.count() == count[0]


@pytest.mark.parametrize("ahead", [0, 1, 5, 7])
def test_stretches_of_any_length(ahead):
    """Pieces and whole blocks of a stretch that starts anywhere and comes in parts, put together."""
    rng, block = random.Random(ahead), 7
    for _ in range(200):
        start, n = rng.randint(0, 30), rng.randint(0, 60)
        stretch, got, at = packing._Stretch(start, block, ahead), {}, start
        while at < start + n:
            size = rng.randint(0, start + n - at)
            pieces, first, whole = stretch.take(np.arange(at, at + size, dtype=np.int32))
            pieces += [(first + k, 0, row) for k, row in enumerate(whole)]
            for k, place, ids in pieces:
                got.setdefault(k, []).extend(zip(range(place, place + len(ids)), ids.tolist(), strict=True))
            at += size
        for k, place, ids in stretch.rest():
            got.setdefault(k, []).extend(zip(range(place, place + len(ids)), ids.tolist(), strict=True))
        want = {k: x for k in range(20) if (x := [(p, k * block + p) for p in range(block + ahead) if start <= k * block + p < start + n])}
        assert {k: sorted(x) for k, x in got.items()} == want


def test_first_of_a_key(spark):
    rng = random.Random(3)
    rows = [(k, None if k % 10 == 0 else "hot" if k % 3 == 0 else f"k{rng.randint(0, 40)}") for k in range(500)]
    rng.shuffle(rows)
    least = {}
    for s, k in rows:
        least[k] = min(s, least.get(k, s))
    got = mark_first(spark.createDataFrame(rows, "seq bigint, key string").repartition(6), "key", "seq", "first").collect()
    assert {(r.seq, r.first) for r in got} == {(s, None if k is None else least[k] == s) for s, k in rows}


def test_padding(spark):
    df = spark.createDataFrame([(0, 0, [1, 2, 3]), (1, 0, [4]), (2, 1, [5, 6, 7, 8, 9])], "seq int, batch_id bigint, tokens array<int>")
    got = {r.seq: r for r in packing.padded(df, 4, pad=0).collect()}
    assert (got[1].input_ids, got[1].attention_mask, got[1].labels) == ([4, 0, 0], [1, 0, 0], [4, -100, -100])
    assert got[2].input_ids == [5, 6, 7, 8]
    waste = {r.batch_id: r.pad_fraction for r in packing.pad_waste(df, 4).collect()}
    assert waste[0] == pytest.approx(1 - 4 / 6) and waste[1] == 0
    full = packing.batch_ids(df.drop("batch_id"), ["seq"], 2, drop_last=True)
    assert sorted(r.seq for r in full.collect()) == [0, 1]


@pytest.mark.parametrize("every", [2, sampling.EVERY])
def test_stratified_walk(spark, every):
    rng = random.Random(4)
    rows = [(k, f"s:{k:08d}", rng.choice(["a", "b"]), k % 5, rng.choice([0, 10, 50, 400])) for k in range(400)]
    df = spark.createDataFrame([(s, i, src, sh, n, "x" * n if n else "  ") for s, i, src, sh, n in rows], "seq bigint, id string, source string, shard int, n_bytes bigint, text string")
    targets = {"a": 3000, "b": 10**6}
    got = sampling.stratified(df, spark.createDataFrame(list(targets.items()), "name string, target bigint"), 7, per_shard=1000, every=every).collect()
    order = {(r.source, r.shard): r.pos for r in sampling.shard_order(df.where(~sampling.is_blank()), 7).collect()}
    for src, target in targets.items():
        n, taken, want = max(1, min(5, target // 1000)), 0, []
        for pos in range(n):
            quota = math.ceil((target - taken) / (n - pos))
            if quota <= 0:
                break
            cum = 0
            for s, _, source, shard, size in rows:
                if source == src and size and order[src, shard] == pos and cum < quota:
                    cum += size
                    want.append(s)
            taken += cum
        mine = sorted((r for r in got if r.source == src), key=lambda r: r.id)
        assert [r.seq for r in mine] == want
        assert [r.id for r in mine] == [f"{src}:{k:08d}" for k in range(len(want))]


def test_fold_has_a_row_a_shard(spark, monkeypatch):
    """Many documents, few of them near a cut: no Python group has more rows than a source has shards."""
    seen = spark.sparkContext.accumulator(0)

    def counted(real):
        def work(rows):
            seen.add(int(len(rows) > 5) + sum(len(x) > 60 for x in rows.get("sums", []) if x is not None))
            return real(rows)

        return work

    for name in ("_reach", "_fold"):
        monkeypatch.setattr(sampling, name, counted(getattr(sampling, name)))
    df = spark.range(6000).select(F.col("id").alias("seq"), F.lit("a").alias("source"), (F.col("id") % 5).cast("int").alias("shard"), (F.col("id") % 37 + 1).alias("n_bytes"), F.lit("x").alias("text"))
    got = sampling.stratified(df, spark.createDataFrame([("a", 50_000)], "name string, target bigint"), 7, per_shard=10_000, every=64)
    assert 50_000 <= got.agg(F.sum("n_bytes")).first()[0] < 50_200 and seen.value == 0
    assert not any("text" in line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line and "_in" not in line and "hashpartitioning(seq" not in line)


def test_cuts(spark):
    """Large samples and heads are filters: the same rows as by sorting, and no plan that gathers them."""
    rng = random.Random(8)
    ids = [rng.randint(-(10**12), 10**12) for _ in range(700)] + list(range(300))
    df = spark.createDataFrame([(i, "x") for i in ids], "id bigint, t string").repartition(6)
    for n in (1, 17, 500, 999, 1000, 5000):
        for cut, sorted_ in ((sampling.first_rows(df, "id", n, few=8), sampling.first_rows(df, "id", n)), (sampling.exact_sample(df, "id", n, 3, few=8), sampling.exact_sample(df, "id", n, 3))):
            assert sorted(r.id for r in cut.collect()) == sorted(r.id for r in sorted_.collect()) and cut.count() == min(n, 1000)
            plan = cut._jdf.queryExecution().executedPlan().toString()
            assert n <= 8 or not any(x in plan for x in ("TakeOrdered", "SinglePartition", "Sort", "Limit"))
    assert sampling.first_rows(df.limit(0), "id", 50, few=8).count() == sampling.exact_sample(df.limit(0), "id", 50, 3, few=8).count() == 0


@pytest.mark.parametrize("span", [2, 5, 256])
def test_affine_scan(spark, span):
    rng = random.Random(span)
    rows = [(g, k * 3 + rng.randint(0, 2), rng.uniform(-1, 1), rng.uniform(-9, 9)) for g in ("a", "b", None) for k in range(90 if g == "a" else 4)]
    df = spark.createDataFrame([r for r in rows if r[0]], "g string, k bigint, f double, o double").repartition(5)
    got = {(r.g, r.k): (r.x, r.f, r.o) for r in affine_scan(df, ["g"], "k", F.col("f"), F.col("o"), "x", span).collect()}
    for g in ("a", "b"):
        x = 0.0
        for _, k, f, o in sorted(r for r in rows if r[0] == g):
            x = f * x + o
            assert got.pop((g, k)) == (pytest.approx(x), f, o)
    assert not got and affine_scan(df.limit(0), ["g"], "k", F.col("f"), F.col("o"), "x", span).count() == 0
    assert "Python" not in affine_scan(df, ["g"], "k", F.col("f"), F.col("o"), "x", span)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block,share", [(4, 3), (1024, 1 << 18)])
def test_mean_vectors(spark, block, share):
    from quarry.operators import embedding

    rng = random.Random(block)
    table = {i: [rng.uniform(-1, 1) for _ in range(3)] for i in range(0, 40, 3)}
    docs = [(k, [rng.randint(0, 45) for _ in range(rng.choice([0, 1, 9, 60]))]) for k in range(25)] + [(99, None), (100, [1])]
    rows = spark.createDataFrame(list(table.items()), "id int, vector array<float>")
    got = {r.seq: (r.n, r["mean"]) for r in embedding.means(spark.createDataFrame(docs, "seq bigint, tokens array<int>").repartition(4), rows, block, share).collect()}
    for k, tokens in docs:
        found = [table[t] for t in tokens or [] if t in table]
        assert (k in got) == bool(found)
        if found:
            assert got[k][0] == len(found) and got[k][1] == pytest.approx([sum(v) / len(found) for v in zip(*found, strict=True)], abs=1e-6)
    assert embedding.means(spark.createDataFrame(docs[:0], "seq bigint, tokens array<int>"), rows).count() == 0
    assert embedding.means(spark.createDataFrame(docs, "seq bigint, tokens array<int>"), rows.limit(0)).count() == 0


def test_limit_and_sample(spark):
    df = spark.range(50)
    assert sampling.first_rows(df, "id", 0).count() == 1 and sampling.first_rows(df, "id", 7).count() == 7
    one, two = (sampling.exact_sample(df.repartition(n), "id", 9, 3).collect() for n in (1, 5))
    assert one == two and len(one) == 9


def test_schedule(spark):
    rows = spark.range(100).select(schedule.lr_at(F.col("id"), 100, 1.0).alias("lr")).collect()
    lr = [r.lr for r in rows]
    assert lr[:5] == pytest.approx([0.2, 0.4, 0.6, 0.8, 1.0]) and lr[5] == pytest.approx(1.0)
    assert all(a >= b for a, b in zip(lr[4:], lr[5:])) and lr[-1] == pytest.approx(0.1, abs=1e-3)
    label = spark.createDataFrame([("lr", 5e-4), ("n_layer", 1.0), ("n_layer", 2.0)], "k string, v double").select(schedule.setting_label(F.col("k"), F.col("v")))
    assert [r[0] for r in label.collect()] == ["lr 5e-4", "1 layer", "2 layers"]


def test_logs(spark, tmp_path):
    for run in ("a", "b"):
        (tmp_path / run).mkdir()
        lines = [{"kind": "step", "step": k, "epoch": 1, "tokens": k * 10, "loss": 5.0 - k / 10, "grad_norm": 1.0, "tokens_per_sec": 100.0 + k} for k in (10, 20, 30)]
        lines += [{"kind": "eval", "step": k, "epoch": 1, "tokens": k * 10, "val_loss": 4.0 - k / 100} for k in (0, 15, 30)] + [{"kind": "epoch", "step": 30, "epoch": 1, "tokens": 300, "train_loss": 3.0}]
        (tmp_path / run / "metrics.jsonl").write_text("\n".join(map(json.dumps, lines)))
    log = runs.read_logs(spark, str(tmp_path / "*/metrics.jsonl"))
    assert {r.run for r in log.collect()} == {"a", "b"} and runs.of_kind(log, "eval").count() == 6
    s = {r.run: r for r in runs.summaries(log).collect()}["a"]
    assert (s.steps, s.tokens_seen, s.best_val_loss, s.median_rate, s.epochs) == (30, 300, 3.7, 120.0, 1)
    assert runs.resumed(log, spark.createDataFrame([("a", 20)], "run string, checkpoint bigint")).where("run = 'a' AND step > 20").count() == 0
    steps = spark.createDataFrame([("r", k, float(k), math.inf if k == 3 else 2.0) for k in range(1, 28)], "run string, step bigint, loss double, grad_norm double")
    w = runs.log_windows(steps, 10, 12).orderBy("step").collect()
    assert [(r.step, r.n_steps, r.loss) for r in w] == [(10, 10, 5.5), (20, 8, 16.5), (27, 3, 26.0)] and w[0].grad_norm == 2.0
    e = runs.ema(steps, ["run"], "step", "loss").orderBy("step").collect()
    acc = None
    for r in e:
        acc = r.loss if acc is None else 0.1 * r.loss + 0.9 * acc
        assert r.ema == pytest.approx(acc)


def test_share_weighted_parts_are_the_whole(spark):
    rng = random.Random(6)
    rows = [("x", rng.random() * 5, rng.randint(1, 100)) for _ in range(50)]
    got = runs.weighted_perplexity(spark.createDataFrame(rows, "r string, loss double, n bigint"), ["r"]).first()
    mean = sum(l * n for _, l, n in rows) / sum(n for *_, n in rows)
    assert got.mean_loss == pytest.approx(mean) and got.ppl == pytest.approx(math.exp(mean))


def test_sweep(spark):
    r = sweep.runs(spark)
    assert sweep.best(r).first().name == "embd_256"
    change = {x.name: x.change for x in sweep.against_baseline(r).collect()}
    assert change["baseline"] == 0 and change["embd_256"] == pytest.approx(-22.0, abs=0.05) and change["lr_5e-4"] == pytest.approx(27.3, abs=0.05)
    assert sum(x.n for x in sweep.parameter_shares(spark).collect()) == 6_846_080
    assert sum(x.share for x in sweep.parameter_shares(spark).collect()) == pytest.approx(1)


def test_top_k_keeps_ties_and_draws_follow_probabilities(spark):
    logits = spark.createDataFrame([(r, t, float(v)) for r in range(400) for t, v in enumerate([3, 1, 2, 2, 0])], "row bigint, token bigint, logit double")
    top = sampling_math.top_k(logits.where("row = 0"), 2).collect()
    assert sorted(r.token for r in top) == [0, 2, 3]
    p = sampling_math.softmax(logits, 1.0)
    assert p.groupBy("row").agg(F.sum("p").alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    drawn = [r.token for r in sampling_math.draw(p, 1).collect()]
    assert drawn.count(0) / 400 == pytest.approx(p.where("row = 0 AND token = 0").first().p, abs=0.1)


def test_bpe(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([("Hello, wörld 漢字",), ("",), (None,)], "t string").select(bpe.encode(F.col("t"), path, "<|endoftext|>").alias("ids"))
    assert [r.ids[-1] for r in df.collect()] == [50256] * 3
    assert [r[0] for r in df.select(bpe.decode(F.col("ids"), path)).collect()] == ["Hello, wörld 漢字", "", ""]
    assert df.select(bpe.generated_context(F.col("ids"), 2, F.lit(7))).first()[0][-2:] == [50256, 7]
    with pytest.raises(ValueError):
        bpe.vocabulary(path, "<nothing>")


def test_stream_first_wins_and_resumes(spark, tmp_path):
    path, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    schema = "doc_id bigint, text string"
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], schema).coalesce(1).write.parquet(path)
    dedup.run_once(dedup.dedup(dedup.arriving(spark, path, schema)), out, ck)
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["a", "b"]
    spark.createDataFrame([(4, "b"), (5, "c")], schema).coalesce(1).write.mode("append").parquet(path)
    dedup.run_once(dedup.dedup(dedup.arriving(spark, path, schema)), out, ck)
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
