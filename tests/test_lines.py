"""Line switches: hand-written sequences and what must come of them."""

import random

import pytest
from pyspark.sql import functions as F

from verseline.config import Parameters
from verseline.operators import observations as obs
from verseline.operators.line_tracker import Cluster, Seen, Tracker, detect, same_line
from verseline.operators.qa import flag_neighbours
from verseline.functions import text as tx
from verseline.schemas import FOUND
from verseline.streaming.lines import _top_level

LONG = "abcdefghijklmnopqrstuv"


def seen(time, text, confidence=0.95, box=None, status="", fragments=None):
    return Seen(f"{round(time * 100):06d}", time, text, tx.display_text(text), tx.match_text(text), confidence, box, status, tx.boundaries(text, fragments))


def track(rows, style="line", **kw):
    t = Tracker("t", style, Parameters(**kw))
    names = [c.split()[0] for c in _top_level(FOUND)]
    out = [dict(zip(names, r)) for r in [r for one in rows for r in t.feed(one)] + t.finish()]
    pick = lambda k: [r for r in out if r["kind"] == k]
    return pick("line"), pick("rejected"), pick("low_confidence")


def every(texts, start=0.0, step=0.25):
    return [seen(start + i * step, t) for i, t in enumerate(texts)]


def test_jitter_blank_and_switch():
    lines, rejected, _ = track(every(["A one", "A one", "X", "A one", "", "", "A one"]) + every(["B two"] * 2, 2.0))
    assert [(r["text"], r["start_time"], r["support_frames"]) for r in lines] == [("A one", 0.0, 4), ("B two", 2.0, 2)]
    assert [(r["text"], r["reason"]) for r in rejected] == [("X", "ocr_jitter")]


def test_unconfirmed_at_the_end():
    lines, rejected, _ = track(every(["A", "A", "X"]))
    assert len(lines) == 1 and rejected[0]["reason"] == "unconfirmed_eof"
    lines, rejected, _ = track([seen(4.0, "A")])
    assert not lines and rejected[0]["support_frames"] == 1


def test_long_blank_starts_the_line_anew():
    lines, _, _ = track(every(["A", "A", "", "", ""]) + every(["A", "A"], 4.0))
    assert [r["start_time"] for r in lines] == [0.0, 4.0]


def test_low_confidence_is_only_logged():
    lines, _, low = track([seen(0, "A"), seen(0.25, "A"), seen(0.5, "X", 0.2), seen(0.75, "A")])
    assert lines[0]["support_frames"] == 3 and len(low) == 1
    lines, _, low = track([seen(0, "A"), seen(0.25, "A"), seen(0.5, "", status="low_confidence"), seen(0.75, "A")], max_blank_frames=0)
    assert len(lines) == 1 and len(low) == 1


def test_typewriter():
    lines, _, _ = track(every(["你", "你好", "你好世", "你好世界", "你好世界"]), "typewriter")
    assert [(r["text"], r["start_time"], r["support_frames"]) for r in lines] == [("你好世界", 0.0, 5)]
    lines, _, _ = track(every(["我爱你", "我爱你"]) + every(["我", "我们", "我们走"], 1.0), "typewriter")
    assert [r["start_time"] for r in lines] == [0.0, 1.0]


def test_near_exact_variants_need_one_frame_more():
    other = LONG[:10] + "X" + LONG[11:]
    lines, rejected, _ = track(every([LONG] * 3 + [other] * 2))
    assert [r["support_frames"] for r in lines] == [3] and rejected[0]["reason"] == "unconfirmed_eof"
    lines, _, _ = track(every([LONG] * 3 + [other] * 3))
    assert len(lines) == 2
    lines, _, _ = track(every([LONG] * 3 + ["XY" + LONG[2:]] * 2))
    assert len(lines) == 2


def test_a_b_a_stays_three_lines():
    lines, _, _ = track(every(["A x", "A x", "B y", "B y", "A x", "A x"]))
    assert [r["support_frames"] for r in lines] == [2, 2, 2]


def test_punctuation_alone_is_a_line_only_without_confirmation():
    assert not track(every(["-", "-"]))[0]
    assert [r["text"] for r in track(every(["-", "-"]), switch_confirm_frames=1)[0]] == ["-"]
    lines, _, _ = track(every(["I love you", "I - love you"]), switch_confirm_frames=1)
    assert [r["text"] for r in lines] == ["I love you"]


def test_medoid_and_its_ties():
    def medoid(*pairs):
        c = Cluster("line", seen(0, *pairs[0]))
        for p in pairs[1:]:
            c.add(seen(0, *p))
        return c.medoid()

    assert medoid(("你的美", 0.80), ("你的羌", 0.99), ("你的美啊", 0.95)) == "你的美"
    assert medoid(("甲乙", 0.60), ("甲丙", 0.95)) == "甲丙"


def test_boundary_votes():
    text = "一二三四五六七八九十天地"
    cuts = [[3], [10], [3, 10], []]

    def parts(at):
        at = [0, *at, len(text)]
        return [text[a:b] for a, b in zip(at, at[1:])]

    lines, _, _ = track([seen(i / 4, text, fragments=parts(c)) for i, c in enumerate(cuts)])
    assert lines[0]["text"] == "一二三 四五六七八九十 天地"
    assert [(s["position"], s["votes"], s["ratio"]) for s in lines[0]["spaces"]] == [(3, 2, 0.5), (10, 2, 0.5)]
    lines, _, _ = track([seen(i / 4, text, fragments=parts([3] if i == 0 else [])) for i in range(4)])
    assert lines[0]["text"] == text
    lines, _, _ = track(every(["ab cd", "ab cd", "abcd"]))
    assert lines[0]["text"] == "ab cd"


def test_same_line_of_short_texts():
    box = [[0.0, 10.0], [50.0, 10.0], [50.0, 20.0], [0.0, 20.0]]
    a, b = seen(0, "abc", 0.7, box), seen(0.25, "abd", 0.9, box)
    assert same_line(a, b, "line", 90)
    assert not same_line(a, b._replace(time=0.75), "line", 90)
    assert not same_line(a._replace(confidence=0.85), b, "line", 90)
    assert not same_line(a, b._replace(box=None), "line", 90)
    assert not same_line(seen(0, "ab", 0.7, box), seen(0, "ac", 0.7, box), "line", 90)
    assert not same_line(seen(0, ""), seen(0, ""), "line", 90)


def frames(spark, rows):
    return spark.createDataFrame(rows, "track_id string, source_index long, time double, text string, confidence double, status string")


def random_frames(seed, tracks=4, n=120):
    r = random.Random(seed)
    texts = ["hello world again", "hello world agaim", "other line here", "short", "shont", "", "", "third text now"]
    out = []
    for t in range(tracks):
        text = r.choice(texts)
        for i in range(n):
            text = r.choice(texts) if r.random() < 0.4 else text
            out.append((f"t{t}", i, i / 4, text, r.choice([0.2, 0.7, 0.95]), r.choice(["", "", "", "low_confidence"])))
    return out


def test_spark_equals_tracker_whatever_the_partitioning(spark):
    rows = random_frames(1)
    expected = []
    for t in sorted({r[0] for r in rows}):
        tr = Tracker(t, "line", Parameters())
        for r in rows:
            if r[0] == t:
                expected += tr.feed(seen(r[2], r[3], r[4], status=r[5])._replace(frame=str(r[1])))
        expected += tr.finish()
    names = [c.split()[0] for c in _top_level(FOUND)]
    expected = [dict(zip(names, e)) for e in expected]
    want = sorted((e["track_id"], e["ordinal"], e["kind"], e["reason"] or "", e["text"], e["support_frames"], e["start_time"]) for e in expected)
    for n in (1, 7):
        got = detect(obs.observations(frames(spark, rows).repartition(n))).collect()
        assert sorted((g.track_id, g.ordinal, g.kind, g.reason or "", g.text, g.support_frames, g.start_time) for g in got) == want


def test_every_confident_frame_ends_up_once(spark):
    rows = random_frames(2)
    got = detect(obs.observations(frames(spark, rows))).groupBy("kind").agg(F.sum("support_frames").alias("n")).collect()
    n = {g.kind: g.n for g in got}
    sure = sum(1 for r in rows if r[3] and r[4] >= 0.5 and r[5] != "low_confidence")
    assert n["line"] + n["rejected"] == sure
    assert n["low_confidence"] == sum(1 for r in rows if r[5] == "low_confidence" or r[3] and r[4] < 0.5)


def test_stream_equals_batch(spark, tmp_path):
    from verseline.streaming.lines import END, detect_stream

    rows = random_frames(3, tracks=2, n=40)
    batch = detect(obs.observations(frames(spark, rows), votes=False)).select("track_id", "kind", "ordinal", "text", "support_frames", "start_time")
    for i in range(2):
        part = [r for r in rows if (r[1] < 20) == (i == 0)] + ([(t, 99, 99.0, "", 0.0, END) for t in ("t0", "t1")] if i else [])
        frames(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames(spark, rows).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = detect_stream(obs.observations(stream, votes=False)).select("track_id", "kind", "ordinal", "text", "support_frames", "start_time")
    query = found.writeStream.format("memory").queryName("streamed").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    if not query.awaitTermination(80):
        query.stop()
        raise AssertionError("the stream did not end")
    key = lambda r: (r.track_id, r.ordinal)
    assert sorted(spark.table("streamed").collect(), key=key) == sorted(batch.collect(), key=key)


def test_style_hints(spark):
    rows = [("type", i, float(i), t, 0.9, "") for i, t in enumerate(["a", "ab", "abc", "abc"])] + [("line", i, float(i), "same text", 0.9, "") for i in range(3)] + [("none", 0, 0.0, "x", 0.9, "")]
    got = {r.track_id: r.style_hint for r in obs.style_details(obs.observations(frames(spark, rows))).collect()}
    assert got == {"type": "typewriter", "line": "line", "none": "uncertain"}
    styles = {r.track_id: r.style for r in obs.with_hinted_style(obs.observations(frames(spark, rows))).collect()}
    assert styles == {"type": "typewriter", "line": "line", "none": "line"}


def test_blank_intervals(spark):
    rows = [("a", i, i / 4, t, c, s) for i, (t, c, s) in enumerate([("x", 1.0, ""), ("", 0.0, ""), ("", 0.0, ""), ("y", 0.1, ""), ("", 0.0, "error"), ("", 0.0, "low_confidence")])]
    got = obs.blank_intervals(obs.observations(frames(spark, rows))).orderBy("start_time").collect()
    assert [(g.start_time, g.end_time, g.frame_count, g.frames) for g in got] == [(0.25, 0.5, 2, ["1", "2"]), (1.0, 1.0, 1, ["4"])]


def test_neighbour_flags(spark):
    rows = [("a", 0.0, 0, "abcdefghij"), ("a", 0.5, 1, "abcdefghix"), ("a", 2.0, 2, "other"), ("a", 3.0, 3, "Other!")]
    got = flag_neighbours(spark.createDataFrame(rows, "track_id string, start_time_raw double, ordinal long, text string")).orderBy("ordinal").collect()
    assert [g.qa_flags for g in got] == [[], ["short_gap", "similar_to_previous"], [], []]


def test_native_medoids_equal_the_cluster(spark):
    r = random.Random(5)
    groups = {g: [(r.choice(["abcd", "abce", "abxd", "ab cd", "zzzz", "-"]), r.choice([0.5, 0.9])) for _ in range(8)] for g in range(6)}
    rows = [(g, i, t, tx.match_text(t), c) for g, m in groups.items() for i, (t, c) in enumerate(m)]
    got = {x.g: x.medoid for x in obs.medoids(spark.createDataFrame(rows, "g int, i int, display_text string, match_text string, confidence double"), "g", "i").collect()}
    for g, m in groups.items():
        c = Cluster("line", seen(0, *m[0]))
        for p in m[1:]:
            c.add(seen(0, *p))
        assert got[g] == c.medoid()


def test_parameters_are_checked():
    for bad in ({"fps": 0}, {"workers": True}, {"confidence_threshold": 1.1}, {"style": "x"}, {"roi": (0, 0, 1, 1), "crop_bottom_ratio": 0.5}, {"roi": (0.5, 0, 0.6, 1)}, {"offset_ms": 1.5}, {"min_line_gap_ms": -1}):
        with pytest.raises(ValueError):
            Parameters(**bad)
    assert Parameters().engine_score_floor == 0.10


def test_boundaries_of_observations(spark):
    texts = ["ab cd", "a b c", "I - love you", "x", "", "ab, cd!", "é f", "w " * 1500 + "end", "good ol' day's & night"]
    got = obs.observations(spark.createDataFrame([("t", i, t) for i, t in enumerate(texts)], "track_id string, source_index long, text string")).collect()
    assert {r.source_index: sorted(r.boundaries or []) for r in got} == {i: tx.boundaries(t) for i, t in enumerate(texts)}
