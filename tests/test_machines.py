"""Automata over a stream against the batch run over the same events, in shuffled batches and after a restart."""

import datetime
import json
import random

from weftline.operators import automaton
from weftline.streaming import machines


def test_the_stream_equals_the_batch(spark, tmp_path):
    for k, v in machines.STORE.items():
        spark.conf.set(k, v)
    r = random.Random(3)
    start = datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC)
    symbols = [*automaton.WORKTREE.symbols, "other"]
    events = [(r.choice("abc"), start + datetime.timedelta(seconds=i // 2), f"{i:05d}", r.choice(symbols)) for i in range(240)]
    near = sorted(events, key=lambda e: e[1].timestamp() + r.random() * 40)  # out of order by less than a minute
    log = tmp_path / "log"
    log.mkdir()
    schema = "key string, time timestamp, place string, symbol string"
    last = {}
    for part in range(4):
        for i in range(2):
            rows = near[(2 * part + i) * 30 : (2 * part + i + 1) * 30]
            (log / f"{part}-{i}.json").write_text("\n".join(json.dumps({"key": k, "time": t.isoformat(), "place": p, "symbol": s}) for k, t, p, s in rows) + "\n")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(log))
        out = machines.followed(stream, automaton.WORKTREE, "60 seconds")

        def keep(batch, number):
            last.update({x.key: (x.state, x.n_legal, x.n_illegal) for x in batch.collect()})

        query = out.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(keep).trigger(availableNow=True).start()
        query.awaitTermination(120)  # each part is a restart
        assert query.exception() is None
        seen = near[: (part + 1) * 60]
        ran = automaton.run(spark.createDataFrame(seen, schema), "key", ["time", "place"], "symbol", automaton.WORKTREE)
        ends = {x.key: x for x in automaton.outcomes(ran, "key", ["time", "place"], []).collect()}
        n = {k: sum(e[0] == k for e in seen) for k in ends}
        assert last == {k: (x.state, n[k] - x.n_illegal, x.n_illegal) for k, x in ends.items()}
