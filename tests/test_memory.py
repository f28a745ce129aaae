"""Prototypes and the queue of unknown persons against a plain loop."""

import numpy as np

from lensfold.operators import memory


def test_memory(spark):
    rng = np.random.default_rng(3)
    rows = [(k, int(rng.choice((0, 1, 1, 1, 7, 9))), rng.normal(size=4).tolist()) for k in range(300)] + [(300, 8, [0.0] * 4)]
    lut, queue, header = {}, [None] * 16, 3
    for k, pid, v in rows:
        if pid < 9:
            new = 0.7 * lut.get(pid, np.zeros(4)) + (1 - 0.7) * np.array(v)
            lut[pid] = new / (np.linalg.norm(new) or 1)
        else:
            queue[header] = k
            header = (header + 1) % 16
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))] + [(400, None, [1.0] * 4), (401, 0, None)], "place long, pid long, v array<double>").repartition(3)
    got = {r.pid: r for r in memory.prototypes(df.filter("pid < 9 or pid is null"), 0.7).collect()}
    assert set(got) == set(lut) and all(np.allclose(got[p].v, lut[p]) and got[p].n == sum(r[1] == p for r in rows) for p in lut)
    unknown = df.filter("pid = 9")
    assert {r.slot: r.place for r in memory.circular_queue(unknown, 16, 3).collect()} == {i: k for i, k in enumerate(queue) if k is not None}
    few = unknown.orderBy("place").limit(5)
    assert sorted(r.slot for r in memory.circular_queue(few, 16, 14).collect()) == [0, 1, 2, 14, 15]
    assert memory.prototypes(df.limit(0)).count() == 0 and memory.circular_queue(few.limit(0), 16).count() == 0
