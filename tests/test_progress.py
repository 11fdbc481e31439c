"""progress_ewma over every event, against a plain loop."""

from twinfold.plans.queries import QUERIES


def test_every_event(spark, tmp_path):
    rows = [(i, (i * 37) % 211) for i in range(4000, 7000)]
    spark.createDataFrame(rows, "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    want = {}
    for i, user in rows:
        n, files, size, fps, bps = want.get(user % 50, (0, 0, 0, 0.0, 0.0))
        f, b = i % 7 + 1, i % 1000 * 97
        weight = 0.075 if n else 1.0
        want[user % 50] = n + 1, files + f, size + b, (1 - weight) * fps + weight * f / 0.75, (1 - weight) * bps + weight * b / 0.75
    got = {r.scan: r for r in QUERIES["progress_ewma"](spark, str(tmp_path)).collect()}
    assert set(got) == set(want)
    for scan, (_, files, size, fps, bps) in want.items():
        r = got[scan]
        assert (r.files, r.bytes) == (files, size) and abs(r.fps - fps) < 1e-5 and abs(r.bps - bps) < 1e-3
