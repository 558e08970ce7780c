"""The ingesting job: whatever is cut, killed, renamed or unreadable, the tables end as one pass over the logs gives them."""

import json
import os
import random
import shutil
import time

import pytest
from pyspark.sql import functions as F

from meterlake.functions.usage import BANDS
from meterlake.operators.capability import capabilities
from meterlake.operators.merge import combine, finish, merge_max, states
from meterlake.plans.reports import sync
from meterlake.sources.producers import NEEDLES, PRODUCERS, facts_from_signals, ledger_events, ledger_steps, parse_a, parse_b
from meterlake.streaming import ingest, listing, tail
from meterlake.streaming.listing import Listing, newest
from meterlake.streaming.store import COUNTED, KEEP, Store
from meterlake.streaming.tail import Lines, TailBatchReader, TailReader, TailSource, batch_lines, read_lines, tail_sample

from .test_stream import line, rollout


class ToldReader(TailReader):
    """Notes what it opens, and cannot read beyond some bytes of a file beside which a file ``.broken`` stands."""

    def open(self, path):
        with open(f"{self.options['opened']}/{os.path.basename(path)}.{time.monotonic_ns()}", "w"):
            pass
        f = open(path, "rb")
        if os.path.exists(f"{path}.broken"):
            with open(f"{path}.broken") as b:
                return Broken(f, int(b.read()))
        return f


class Broken:
    def __init__(self, f, most):
        self.f, self.most = f, most

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.f.close()

    def seek(self, at):
        return self.f.seek(at)

    def read(self, n):
        if self.f.tell() >= self.most:
            raise OSError(5, "Input/output error")
        return self.f.read(min(n, self.most - self.f.tell()))


class ToldSource(TailSource):
    @classmethod
    def name(cls):
        return "jsonl_tail_told"

    def streamReader(self, schema):
        return ToldReader(self.options)


# reading


def test_needles_anywhere_in_a_line():
    """Lines found by needles, at every cut, against a plain filter; all lines are counted."""
    import io

    rnd = random.Random(4)
    needles = (b"usage", b"age\"")
    parts = [b"usage", b"us", b"age\"", b"x" * 50, b"", b"\xc3\xa9", b" "]
    for _ in range(30):
        data = b"\n".join(b"".join(rnd.choice(parts) for _ in range(rnd.randrange(6))) for _ in range(30))
        want, at = [], 0
        for x in data.split(b"\n")[:-1]:
            if any(n in x for n in needles):
                want.append((at, len(x), x))
            at += len(x) + 1
        for cut in range(0, len(data) + 1, 7):
            a, b = Lines(io.BytesIO(data), 0, cut, needles), Lines(io.BytesIO(data), cut, len(data), needles)
            assert [*a, *b] == want and a.seen + b.seen == data.count(b"\n")


def test_late_needles_and_oversize_lines(spark, tmp_path, monkeypatch):
    """A needle counts wherever it stands, in batches, streams and mere columns; of an oversize line too, whose head alone goes on."""
    late = json.loads(line("s", "r", 5))
    late = json.dumps({"pad": "y" * 6000, **late}, separators=(",", ":"))
    (tmp_path / "a.jsonl").write_text(late + "\n" + "z" * 9000 + "\n")
    lines = spark.createDataFrame([("f", 0, late)], "file_id string, ordinal long, value string")
    assert parse_a(lines).usage.count() == 1
    assert parse_a(batch_lines(spark, str(tmp_path), "*.jsonl", NEEDLES["a"])).usage.first().output_total == 5
    for name, value in (("MAX_LINE", 1000), ("HEAD", 20), ("CHUNK", 64)):
        monkeypatch.setattr(tail, name, value)
    size = (tmp_path / "a.jsonl").stat().st_size
    assert [(at, n, x) for at, n, x in read_lines(str(tmp_path / "a.jsonl"), 0, size, (b'"usage"',))] == [(0, len(late), late[:20].encode())]
    assert [(at, n) for at, n, _ in read_lines(str(tmp_path / "a.jsonl"), 0, size)] == [(0, len(late)), (len(late) + 1, 9000)]


def test_sync_shuffles_no_raw_line(spark, tmp_path):
    """Lines are parsed where they are read; what a ledger's windows and the merge exchange are parsed columns. Keys are the stream's."""
    (tmp_path / "rollout-1.jsonl").write_text("\n".join(rollout()) + "\n" + line("s", "r", 3) + "\n")

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    a, b = (batch_lines(spark, str(tmp_path), "*.jsonl", NEEDLES[x]) for x in "ab")
    for df in (parse_a(a).signals, ledger_events(b)):
        assert not any(x in plan(df) for x in ("Window", "Join", "Aggregate", "Repartition"))
    assert plan(parse_b(b).signals).count("RelationV2") == 1
    whole = plan(sync(spark, {"claude_code": str(tmp_path), "codex": str(tmp_path)}))
    assert whole.count("RelationV2") == 2 and whole.count("Aggregate") == 1 and "Join" not in whole
    reader = TailReader({"path": str(tmp_path)})
    streamed = {(r[0], r[2]) for s in reader.partitions({}, reader.latestOffset()) for r in reader.read(s)}
    assert {(r.file_id, r.ordinal) for r in batch_lines(spark, str(tmp_path)).collect()} == streamed


def test_listing_is_kept(tmp_path, monkeypatch):
    """An idle tree is not listed again; new, renamed and removed entries are seen, also in folders that have just changed."""
    for k in range(3):
        (tmp_path / f"d{k}/e").mkdir(parents=True)
        (tmp_path / f"d{k}/e/{k}.jsonl").write_text("x\n")
    files = Listing(str(tmp_path), "*.jsonl")
    assert len(files.files()) == 3 and files.listed == 7
    files.files()
    assert files.listed == 14  # just made: not trusted yet
    for folder in (tmp_path, *tmp_path.glob("d*"), *tmp_path.glob("d*/e")):
        os.utime(folder, (time.time() - 60, time.time() - 60))
    files.files()
    before = files.listed
    (tmp_path / "d0/e/0.jsonl").open("a").write("more\n")
    assert max(f.size for f in files.files().values()) == 7 and files.listed == before
    (tmp_path / "d1/e/new.jsonl").write_text("")
    (tmp_path / "d2/e/2.jsonl").rename(tmp_path / "d2/e/two.jsonl")
    shutil.rmtree(tmp_path / "d0")
    assert sorted(os.path.basename(f.path) for f in files.files().values()) == ["1.jsonl", "new.jsonl", "two.jsonl"] and files.listed == before + 3
    monkeypatch.setattr(listing, "SETTLED_NS", -(10**18))
    os.utime(tmp_path / "d1/e/1.jsonl", (2**31, 2**31))
    assert [os.path.basename(f.path) for f in newest(files.files(), 1)] == ["1.jsonl"]


def test_a_sample_reads_the_ends_of_the_latest_files(spark, tmp_path):
    """Of 20 files of 2 MB the last 64 KB of five are read, without a first line that is cut."""
    whole = line("s", "r", 3, isSidechain=True, pad="p" * 900) + "\n"
    for k in range(20):
        path = tmp_path / f"{k:02}.jsonl"
        path.write_text(whole * 2000)
        os.utime(path, (1000 + k, 1000 + k))
    reader = TailBatchReader({"path": str(tmp_path), "newest": "5", "tail_bytes": "65536", "needles": json.dumps(NEEDLES["a"])})
    read = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def seek(self, at):
            return self.f.seek(at)

        def read(self, n):
            data = self.f.read(n)
            read.append(len(data))
            return data

    reader.open = lambda path: Counted(open(path, "rb"))
    rows = [r for s in reader.partitions() for r in reader.read(s)]
    assert sum(read) == 5 * 65536 and {os.path.basename(r[1]) for r in rows} == {"15.jsonl", "16.jsonl", "17.jsonl", "18.jsonl", "19.jsonl"}
    assert len(rows) == 5 * (65536 // len(whole)) and all(r[4] + "\n" == whole for r in rows)
    (tmp_path / "rollout-x.jsonl").write_text("\n".join(rollout()) + "\n")
    got = {(r.adapter_id, r.capability): r.state for r in capabilities(ingest.probe(spark, {"claude_code": str(tmp_path), "codex": str(tmp_path)}, tail_bytes=4096)).collect()}
    assert got["claude_code", "sub_agent_attribution"] == "supported" and got["codex", "model_identity"] == "supported"
    assert tail_sample(spark, str(tmp_path / "none")).count() == 0


# one answer for batches and parts


def test_parts_and_batches_give_one_answer(spark):
    """First attributes, first known model, latest record: whatever the parts and however often they come."""
    rnd = random.Random(6)
    names = "event_id string, occurred_at timestamp, adapter_id string, session_id string, dedup_key string, model_id string, request_kind string, measurement_source string, raw_json string, is_sidechain boolean, "
    rows = [
        (f"f:{k:04}:0", rnd.choice([0, 1]), "a", "s", f"k{rnd.randrange(8)}", rnd.choice([None, "z", "a"]), rnd.choice(["turn", "off"]), rnd.choice("xy"), rnd.choice([None, f"{{{k}}}"]), rnd.random() < 0.2, *[rnd.randrange(9) for _ in BANDS], rnd.choice([None, 3]))
        for k in range(60)
    ]
    df = spark.createDataFrame(rows, names.replace("occurred_at timestamp", "at long") + ", ".join(f"{b} long" for b in (*BANDS, "reasoning")))
    df = df.withColumn("occurred_at", F.timestamp_seconds("at")).cache()
    whole = finish(combine(states(df))).collect()
    parts = [combine(states(df.filter(F.pmod(F.hash("event_id"), F.lit(5)) == k))) for k in (3, 1, 4, 0, 2, 1)]
    again = parts[0]
    for p in parts[1:]:
        again = combine(again.unionByName(p))
    drop = lambda rs: sorted(tuple(v for k, v in r.asDict().items() if k != "copies") for r in rs)
    assert drop(finish(again).collect()) == drop(whole)
    by_hand = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        own = by_hand.setdefault(r[4], {"kind": r[6], "source": r[7], "model": None, "raw": None})
        own["model"], own["raw"] = own["model"] or r[5], r[8] or own["raw"]
    assert {r.dedup_key: (r.request_kind, r.measurement_source, r.model_id, r.raw_json) for r in whole} == {k: tuple(v[c] for c in ("kind", "source", "model", "raw")) for k, v in by_hand.items()}
    assert merge_max(df).count() == len(by_hand)


# the store

A_LINES = [
    [line("s", "r1", 1, pad=1), line("s", "r1", 378), line("s", "q", 3, isApiErrorMessage=True), "nonsense \"usage\""],
    [line("s", "r2", 7), line("s", "r1", 2), line("s", "q", 3, isApiErrorMessage=True), '{"type":"system","sessionId":"s","subtype":"api_error"}'],
    [line("t", "r9", 4), line("s", "q", 9)],
]


def signals_of(spark, batch, lines):
    rows = [("f", 1000 * batch + k, x, None, None, None) for k, x in enumerate(lines)]
    rows.append(("f", 1000 * batch, None, len(lines), True, 1000 * batch + len(lines)))
    df = spark.createDataFrame(rows, "file_id string, ordinal long, value string, lines long, hit boolean, until long")
    size = F.when(F.col("lines").isNotNull(), F.col("lines")).otherwise(F.octet_length("value")).cast("long")
    return parse_a(df.withColumns({"bytes": size, "path": F.lit("/logs/f"), "error": F.lit(None).cast("string")}), "2024-01-01 00:00:00").signals


def tables(spark, store):
    found = {"facts": store.facts(spark), "per_source": store.per_source(spark), "failures": store.failures(spark), "anomalies": store.anomalies(spark), "passes": store.table(spark, "passes"), "cursors": store.cursors(spark)}
    return {k: sorted(map(str, df.collect())) for k, df in found.items() if df is not None}


@pytest.fixture
def one_partition(spark):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", held)


def test_a_kill_between_any_two_writes(spark, one_partition, tmp_path, monkeypatch):
    """Readers see a whole batch or none of it, and a replay gives what an undisturbed run gives."""
    good = Store(str(tmp_path / "good"), fanout=2, buckets=4)
    want = []
    for k, lines in enumerate(A_LINES):
        good.ingest(signals_of(spark, k, lines), k)
        want.append(tables(spark, good))
    last = want[-1]
    assert len(last["facts"]) == 5 and len(last["failures"]) == 1 and sum("request_failed" in r for r in last["anomalies"]) == 1 and sum("malformed_line" in r for r in last["anomalies"]) == 1
    write, publish = Store._write, Store._publish
    before = Store(str(tmp_path / "before"), fanout=2, buckets=4)
    for k in (0, 1):
        before.ingest(signals_of(spark, k, A_LINES[k]), k)
    steps = 0

    class Killed(Exception):
        pass

    for at in range(100):
        store = Store(str(tmp_path / f"killed{at}"), fanout=2, buckets=4)
        shutil.copytree(before.path, store.path)
        steps = 0

        def step(f, at=at):
            def run(*args):
                nonlocal steps
                steps += 1
                if steps == at + 1:
                    raise Killed
                return f(*args)

            return run

        monkeypatch.setattr(Store, "_write", step(write))
        monkeypatch.setattr(Store, "_publish", step(publish))
        killed = False
        try:
            store.ingest(signals_of(spark, 2, A_LINES[2]), 2)
        except Killed:
            killed = True
        monkeypatch.setattr(Store, "_write", write)
        monkeypatch.setattr(Store, "_publish", publish)
        assert store.manifest(spark) == before.manifest(spark) if killed else tables(spark, store) == want[2]
        store.ingest(signals_of(spark, 2, A_LINES[2]), 2)  # the replay
        store.vacuum(spark)
        assert tables(spark, store) == want[2]
        if not killed:
            break
    assert steps >= 7


def test_rows_are_rewritten_once_a_level(spark, one_partition, tmp_path):
    """Parts per table stay few, rewritten rows grow with the logarithm, old parts go."""
    store = Store(str(tmp_path), fanout=3, buckets=2)
    columns = "event_id string, occurred_at timestamp, adapter_id string, session_id string, dedup_key string, model_id string, request_kind string, measurement_source string, raw_json string, is_sidechain boolean, " + ", ".join(f"{b} long" for b in (*BANDS, "reasoning"))
    write, rewritten = Store._write, []

    def counted(self, rows, table, level, batch):
        part = write(self, rows, table, level, batch)
        if level and table == "requests":
            rewritten.append(spark.read.parquet(f"{self.path}/{part['name']}").count())
        return part

    Store._write = counted
    try:
        batches = 20
        for k in range(batches):
            at = spark.sql("select timestamp'2024-01-01'").first()[0]
            rows = spark.createDataFrame([(f"f:{k}:0", at, "a", "s", f"k{k}", None, "turn", "x", None, False, *[k] * (len(BANDS) + 1))], columns)
            each = combine(states(rows)).cache()
            empty = {"spans": spark.createDataFrame([], "adapter_id string, batch long, file_id string, path string, ordinal long, bytes long, until long, lines long, hit boolean, error string")}
            store.commit(spark, k, {"requests": each, **empty}, [])
    finally:
        Store._write = write
    assert store.facts(spark).count() == batches and sum(rewritten) <= batches * 3
    live = [p for p in store.manifest(spark)["parts"] if p["table"] == "requests"]
    assert len(live) <= 3 * 3 and max(p["level"] for p in live) == 2
    assert len(store._versions(spark)) == KEEP
    listed = {p["name"] for v in store._versions(spark) for p in store.manifest(spark, v)["parts"]}
    assert {f"requests/{n}" for n in store._names(spark, "requests")} <= listed and store.vacuum(spark) == 0


# the job


def places(tmp_path, *adapters):
    roots = {a: str(tmp_path / "logs" / a) for a in adapters}
    for r in roots.values():
        os.makedirs(r, exist_ok=True)
    os.makedirs(tmp_path / "opened", exist_ok=True)
    return roots, str(tmp_path / "base"), {"source": ToldSource, "opened": str(tmp_path / "opened")}


def write(path, text, mode="a"):
    with open(path, mode) as f:
        f.write(text)


SHOWN = ["adapter_id", "session_id", "dedup_key", *BANDS, "reasoning", "model_id", "request_kind", "measurement_source", "raw_json", "is_sidechain", "event_id"]


def shown(df):
    return sorted(map(str, df.select(*SHOWN).collect()))


def test_catch_up_at_every_cut(spark, one_partition, tmp_path):
    """Files grow at cuts within lines, one is renamed and one copied: tables, counters, cursors and ledger end as one pass has them."""
    roots, base, told = places(tmp_path, "claude_code", "codex")
    a, b = "\n".join(x for xs in A_LINES for x in xs) + "\n", "\n".join(rollout()) + "\n"
    progress = ingest.Progress()
    spark.streams.addListener(progress)
    try:
        cuts = [0, 0.2, 0.55, 0.8, 1]
        for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
            name = "a.jsonl" if k < 2 else "renamed.jsonl"
            if k == 2:
                os.rename(f"{roots['claude_code']}/a.jsonl", f"{roots['claude_code']}/renamed.jsonl")
            write(f"{roots['claude_code']}/{name}", a[int(x * len(a)) : int(y * len(a))])
            write(f"{roots['codex']}/rollout-1.jsonl", b[int(x * len(b)) : int(y * len(b))])
            ingest.catch_up(spark, roots, base, **told)
            assert shown(ingest.facts(spark, base, roots)) == shown(sync(spark, roots))
        for store in (ingest.store(base, x) for x in roots):
            lines = store.table(spark, "spans").agg(F.sum("lines"), F.sum("bytes")).first()
            assert store.table(spark, "passes").agg(F.sum("lines_read")).first()[0] == lines[0]
            cursor = store.cursors(spark).collect()
            assert [(os.path.basename(c.path), c.place, c.held) for c in cursor] in ([("renamed.jsonl", len(a.encode()), False)], [("rollout-1.jsonl", len(b.encode()), False)])
        # nothing is opened when nothing changed
        before = len(os.listdir(told["opened"]))
        assert all(not p for p in ingest.catch_up(spark, roots, base, **told).values()) and len(os.listdir(told["opened"])) == before
        # a copy is another file with the same requests
        shutil.copy(f"{roots['claude_code']}/renamed.jsonl", f"{roots['claude_code']}/copy.jsonl")
        ingest.catch_up(spark, roots, base, **told)
        got = ingest.store(base, "claude_code").facts(spark)
        assert got.count() == 5 and ingest.store(base, "claude_code").cursors(spark).count() == 2
        # the counters of passes are those of a recount, and the listener's
        totals = ingest.passes(spark, base, roots).groupBy("adapter_id").agg(*(F.sum(c).alias(c) for c in COUNTED)).collect()
        totals = {r.adapter_id: r for r in totals}
        recount = parse_a(batch_lines(spark, roots["claude_code"], "*.jsonl", NEEDLES["a"])).signals.groupBy("signal").count().collect()
        recount = {r.signal: r["count"] for r in recount}
        own = totals["claude_code"]
        assert (own.failures, own.retry_attempts, own.anomalies, own.usage_recorded + own.duplicates) == tuple(recount[k] for k in ("failure", "retry", "anomaly", "usage"))
        assert own.usage_recorded == 4 and own.lines_read == 2 * a.count("\n") and totals["codex"].files_scanned == 4 and own.files_skipped == 1
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        heard = progress.state[f"claude_code of {base}"]
        deadline = time.time() + 20
        while heard["cumulative"].get("lines_read") != own.lines_read and time.time() < deadline:
            time.sleep(0.2)
        assert heard["cumulative"]["lines_read"] == own.lines_read and heard["cumulative"]["failure"] == own.failures and heard["last_pass_at"]
    finally:
        spark.streams.removeListener(progress)
    # the ledger's state is what a batch over the file ends with
    steps = ledger_steps(ledger_events(batch_lines(spark, roots["codex"], "rollout-*.jsonl", NEEDLES["b"])))
    end = steps.orderBy(F.desc("ordinal")).first()
    state = ingest.ledger_cursors(spark, base).collect()
    assert [(s.session_id, s.model_id, s.ordinal, s.number) for s in state] == [(end.session_id, end.model_id, end.ordinal, 6)]
    assert state[0].counters[-1] == 10


def test_triggers_admit_bounded_bytes(spark, one_partition, tmp_path):
    """A backlog is read in triggers of at most so many bytes, the latest file first."""
    roots, base, told = places(tmp_path, "claude_code")
    for k in range(6):
        path = f"{roots['claude_code']}/{k}.jsonl"
        write(path, "".join(line("s", f"{k}-{i}", i) + "\n" for i in range(20)))
        os.utime(path, (1000 + k, 1000 + k))
    size = os.path.getsize(f"{roots['claude_code']}/5.jsonl")
    ingest.catch_up(spark, roots, base, max_bytes=2 * size, **told)
    spans = ingest.store(base, "claude_code").table(spark, "spans").collect()
    by = {}
    for s in spans:
        by.setdefault(s.batch, []).append(s)
    assert len(by) >= 3 and all(sum(s.bytes for s in own) <= 2 * size for own in by.values())
    assert any(s.path.endswith("5.jsonl") for s in by[min(by)]) and ingest.store(base, "claude_code").facts(spark).count() == 120


@pytest.mark.parametrize("adapter", ["claude_code", "codex"])
def test_an_unreadable_file_keeps_its_place(spark, one_partition, tmp_path, adapter):
    """A file that fails in the middle is held there with one anomaly while others go on; it is read on when it can be, also by a new process."""
    roots, base, told = places(tmp_path, adapter)
    name = "rollout-{}.jsonl"
    text = "\n".join(rollout()) + "\n" if adapter == "codex" else "\n".join(A_LINES[0]) + "\n" + "\n".join(A_LINES[1]) + "\n"
    other = text.replace('"id": "s"', '"id": "o"').replace('"sessionId":"s"', '"sessionId":"o"')
    bad, good = (f"{roots[adapter]}/{name.format(k)}" for k in (1, 2))
    write(bad, text)
    write(good, other)
    write(f"{bad}.broken", str(len(text) // 2))
    ingest.catch_up(spark, roots, base, **told)
    store = ingest.store(base, adapter)

    def held():
        return {os.path.basename(c.path): (c.place, c.held) for c in store.cursors(spark).collect()}

    place = text[: len(text) // 2].rfind("\n") + 1
    assert held() == {"rollout-1.jsonl": (place, True), "rollout-2.jsonl": (len(other), False)}
    write(bad, "")  # nothing new
    write(good, "\n")
    ingest.catch_up(spark, roots, base, **told)  # a new reader tries again, in vain
    assert held()["rollout-1.jsonl"] == (place, True) and held()["rollout-2.jsonl"] == (len(other) + 1, False)
    assert [r.ordinal for r in store.anomalies(spark).filter("kind = 'unreadable_file'").collect()] == [place]
    os.remove(f"{bad}.broken")
    write(bad, "\n")
    ingest.catch_up(spark, roots, base, **told)
    ingest.catch_up(spark, roots, base, **told)  # what it gained while it was held
    assert held() == {"rollout-1.jsonl": (len(text) + 1, False), "rollout-2.jsonl": (len(other) + 1, False)}
    assert shown(store.facts(spark)) == shown(sync(spark, roots)) and store.open_failures(spark) == {}


def test_a_file_that_was_away_at_a_restart(spark, one_partition, tmp_path):
    """Absent at the first trigger of a new process, it is not read anew when it is back."""
    roots, base, told = places(tmp_path, "claude_code")
    path = f"{roots['claude_code']}/a.jsonl"
    write(path, "\n".join(A_LINES[0]) + "\n")
    ingest.catch_up(spark, roots, base, **told)
    os.rename(path, str(tmp_path / "away"))
    ingest.catch_up(spark, roots, base, **told)
    os.rename(str(tmp_path / "away"), path)
    opened = len(os.listdir(told["opened"]))
    ingest.catch_up(spark, roots, base, **told)
    assert len(os.listdir(told["opened"])) == opened
    write(path, A_LINES[2][0] + "\n")
    ingest.catch_up(spark, roots, base, **told)
    spans = ingest.store(base, "claude_code").table(spark, "spans").collect()
    assert sorted((s.ordinal, s.bytes) for s in spans) == [(0, len("\n".join(A_LINES[0])) + 1), (len("\n".join(A_LINES[0])) + 1, len(A_LINES[2][0]) + 1)]


def test_following(spark, one_partition, tmp_path):
    """Streams that go on read what is appended; their state stays for a later catch-up."""
    roots, base, told = places(tmp_path, "claude_code")
    queries = ingest.follow(spark, roots, base, every="0 seconds", **told)
    try:
        for xs in A_LINES:
            write(f"{roots['claude_code']}/a.jsonl", "\n".join(xs) + "\n")
            for q in queries:
                q.processAllAvailable()
    finally:
        for q in queries:
            q.stop()
    assert shown(ingest.facts(spark, base, roots)) == shown(sync(spark, roots))
    assert ingest.facts(spark, base, ["copilot"]) is None and {p.adapter_id for p in PRODUCERS} >= set(roots)
    assert facts_from_signals(parse_a(batch_lines(spark, roots["claude_code"]))).count() >= 4


def test_a_gauge_is_sampled(spark, one_partition, tmp_path):
    """Values of a day only grow, days stay when the document drops them, and what is no reading changes nothing."""
    path, base = tmp_path / "gauge.json", str(tmp_path / "base")

    def sampled(text):
        if text is not None:
            path.write_text(text)
        got = ingest.sample_gauge(spark, str(path), base)
        return None if got is None else sorted((r.day, r.tokens) for r in got.collect())

    assert sampled(None) is None and sampled("nonsense") is None
    assert sampled('{"tokens-today":{"date":"2024-01-01","tokens":0}}') == [("2024-01-01", 0)]
    assert sampled('{"tokens-today":{"date":"2024-01-01","tokens":70}}') == [("2024-01-01", 70)]
    version = ingest.Store(os.path.join(base, "gauge", "store")).manifest(spark)["version"]
    assert sampled('{"tokens-today":{"date":"2024-01-01","tokens":9}}') == [("2024-01-01", 70)] and sampled('{"tokens-today":{"date":" ","tokens":9}}') == [("2024-01-01", 70)]
    assert ingest.Store(os.path.join(base, "gauge", "store")).manifest(spark)["version"] == version
    assert sampled('{"tokens-today":{"date":"2024-01-02","tokens":5}}') == [("2024-01-01", 70), ("2024-01-02", 5)]
    path.unlink()
    assert sampled(None) == [("2024-01-01", 70), ("2024-01-02", 5)]
