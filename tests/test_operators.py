"""Functions, recognition, LRC, alignment, event logs, metadata and stage reuse on small fixtures."""

import itertools
import json
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verseline.config import Job, Parameters, short_number
from verseline.functions import geometry, numbers, text, timecode
from verseline.operators import alignment, qa, recognition
from verseline.plans import stages
from verseline.schemas import ITEM
from verseline.sources import event_log, lrc, media

LEFT = [[0.0, 10.0], [20.0, 10.0], [20.0, 20.0], [0.0, 20.0]]
RIGHT = [[25.0, 10.0], [50.0, 10.0], [50.0, 20.0], [25.0, 20.0]]
BELOW = [[5.0, 40.0], [80.0, 40.0], [80.0, 52.0], [5.0, 52.0]]


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcé ", max_size=12), st.text("abcé ", max_size=12))
def test_edit_distance(a, b):
    assert text.edit_distance(a, b) == slow_distance(a, b)


def test_text_layers():
    shown = text.display_text("  Ａ＆Ｂ　don’t，停！  ♪ ")
    assert shown == "A&B don’t,停!"
    assert text.match_text(shown) == "a&bdon't停"
    assert text.evaluation_text("A+B #1 (x) $ Don’t") == "a+b#1xdon't"
    assert text.display_text(None) == "" and text.display_text("a​b\x07\tc\n") == "ab c"


def test_columns_equal_the_functions(spark):
    rows = ["", None, "  Hello,  World! ", "tab\tnl\n\x07bell\x1fsep\x7f", "&'()*^`|~<=>$+-_{}[]@\\", "Straße É İ ﬁ ①", "  Ａ＆Ｂ　don’t，停！  ♪ ", "don't & <b>", "#+"]
    t = F.col("t")
    got = spark.createDataFrame([(r,) for r in rows], "t string").select("t", text.display(t).alias("d"), text.match(t).alias("m"), text.evaluation(t).alias("e")).collect()
    for r in got:
        assert (r.d, r.m, r.e) == (text.display_text(r.t), text.match_text(r.t), text.evaluation_text(r.t))


def test_similarity(spark):
    row = spark.createDataFrame([("abcdefghij", "abcdefghix", "", "x")], "a string, b string, e string, x string")
    a, b, e, x = map(F.col, "abex")
    got = row.select(text.similarity_percent(a, b), text.similarity(e, e), text.character_error_rate(e, x), text.character_error_rate(x, a), text.fragments_joined(F.array(F.lit("ab"), F.lit("c"), F.lit("好"), F.lit("d")))).first()
    assert tuple(got) == (90.0, 1.0, 1.0, 10.0, "ab c好d")


def test_timestamps(spark):
    cases = {0.0: "00:00.00", 59.995: "01:00.00", 65.004: "01:05.00", 65.005: "01:05.01", -1.2: "00:00.00", 6005.67: "100:05.67", 0.125: "00:00.13"}
    got = spark.createDataFrame([(k,) for k in cases], "s double").select("s", timecode.timestamp(timecode.centiseconds(F.col("s"))).alias("t")).collect()
    assert {r.s: r.t for r in got} == cases
    with pytest.raises(Exception):
        spark.createDataFrame([(float("nan"),)], "s double").select(timecode.centiseconds(F.col("s"))).collect()


def test_centiseconds_are_rounded_once(spark):
    cases = {0.565 - 0.5: 6, 0.605 - 0.5: 10, 0.705 - 0.5: 20, 0.965 - 0.5: 46, 0.06500000000000002: 7, 0.065: 7, 0.004999999999999999: 0, 0.005: 1, -0.06499999999999995: -6, 123456789.125: 12345678913}
    got = spark.createDataFrame([(k,) for k in cases], "s double").select("s", timecode.centiseconds(F.col("s"), clamp=False).alias("c")).collect()
    assert {r.s: r.c for r in got} == cases
    assert cases == {s: int((Decimal(str(s)) * 100).quantize(Decimal(1), ROUND_HALF_UP)) for s in cases}
    lines = spark.createDataFrame([("a", 0, 0.0, "x"), ("a", 1, 0.705, "y")], "track_id string, ordinal long, start_time_raw double, text string")
    assert lrc.render(qa.prepare(lines, -500)).first().content == "[00:00.00]x\n[00:00.20]y\n"


def test_frame_index(spark):
    got = media.frame_index(spark.createDataFrame([("/x/000001.png",), ("/x/000002.png",), ("/x/000100.png",), ("/x/a.png",)], "path string"), 4).orderBy("frame").collect()
    assert [(r.frame_number, r.time, r.time_fraction) for r in got] == [(1, 0.0, "0"), (2, 0.25, "1/4"), (100, 24.75, "99/4")]
    assert timecode.rate_text("30000/1001") == "30000/1001"
    for bad in (0, "x", "1/0"):
        with pytest.raises(ValueError):
            timecode.rate(bad)


def test_regions(spark):
    got = spark.range(1).select(geometry.resolve_roi(geometry.parse_roi(F.lit("0.1,0.2,0.5,0.25")), F.lit(1920), F.lit(1080)).alias("a"), geometry.resolve_roi(geometry.bottom_roi(), F.lit(100), F.lit(50)).alias("b")).first()
    assert (got.a.x, got.a.y, got.a.width, got.a.height) == (192, 216, 960, 270) and (got.b.y, got.b.height) == (30, 20)
    for bad in ("0,0,1", "0,0,0,1", "0.6,0,0.5,1", "a,0,1,1"):
        with pytest.raises(Exception):
            spark.range(1).select(geometry.parse_roi(F.lit(bad))).collect()


def frame(spark, items, **kw):
    rows = [(1, [{"text": t, "confidence": c, "box": b} for t, c, b in items])]
    return recognition.read_frames(spark.createDataFrame(rows, "id int, raw_items array<struct<text:string,confidence:double,box:array<array<double>>>>"), **kw).first()


def test_rows_are_clustered_and_one_is_chosen(spark):
    got = frame(spark, [("下句", 0.9, BELOW), ("世界", 0.9, RIGHT), ("你好", 0.9, LEFT)])
    assert [v.text for v in got.visual_lines] == ["你好世界", "下句"] and got.visual_lines[0].source_indices == [2, 1]
    two = [("上面", 0.9, LEFT), ("下面活动行", 0.9, BELOW)]
    assert [frame(spark, two, active=a).text for a in ("top", "bottom", "auto")] == ["上面", "下面活动行", "下面活动行"]
    assert frame(spark, two, band=(0.1, 0.4), frame_height=F.lit(100.0)).text == "上面"
    low = frame(spark, [("x", 0.2, LEFT)])
    assert (low.status, low.text, len(low.rejected_items)) == ("low_confidence", "", 1)
    assert frame(spark, []).status == "empty"
    mixed = frame(spark, [("a", 0.9, LEFT), ("no box", 0.8, [])])
    assert [v.text for v in mixed.visual_lines] == ["a", "no box"] and not mixed.visual_lines[1].geometry_available


def brute_rows(boxes):
    """Greedy clustering written out on plain numbers: (top, bottom) lists in order of centre and left edge."""
    rows = []
    for k in sorted(range(len(boxes)), key=lambda k: ((boxes[k][2] + boxes[k][3]) / 2, boxes[k][0], k)):
        x0, x1, y0, y1 = boxes[k]
        best = None
        for n, r in enumerate(rows):
            overlap = max(0.0, min(y1, r["b"]) - max(y0, r["t"])) / min(max(y1 - y0, 1e-6), max(r["b"] - r["t"], 1e-6))
            away = abs((y0 + y1) / 2 - (r["t"] + r["b"]) / 2)
            if (overlap >= 0.3 or away <= 0.65 * max(y1 - y0, r["b"] - r["t"])) and (best is None or away < best[0]):
                best = (away, n)
        if best:
            r = rows[best[1]]
            r["t"], r["b"], r["x"] = min(r["t"], y0), max(r["b"], y1), min(r["x"], x0)
            r["m"].append(k)
        else:
            rows.append({"t": y0, "b": y1, "x": x0, "m": [k]})
    return [sorted(r["m"], key=lambda k: (boxes[k][0], k)) for r in sorted(rows, key=lambda r: ((r["t"] + r["b"]) / 2, r["x"]))]


def test_row_clusters_equal_brute_force(spark):
    r = random.Random(4)
    frames, wanted = [], {}
    for i in range(60):
        boxes = [(x := r.randint(0, 90), x + r.randint(1, 30), y := r.randint(0, 60), y + r.randint(1, 20)) for _ in range(r.randint(1, 7))]
        frames.append((i, [{"text": f"t{k}", "confidence": 0.9, "box": [[float(a), float(c)], [float(b), float(d)]]} for k, (a, b, c, d) in enumerate(boxes)]))
        wanted[i] = brute_rows([tuple(map(float, b)) for b in boxes])
    got = recognition.read_frames(spark.createDataFrame(frames, "id int, raw_items array<struct<text:string,confidence:double,box:array<array<double>>>>")).select("id", "visual_lines.source_indices").collect()
    assert {g.id: g.source_indices for g in got} == wanted


def test_results_of_any_shape():
    want = [{"text": "a", "confidence": 0.5, "box": [[0, 0], [9, 9]]}]

    class Result:
        boxes, txts, scores = [[0, 0, 9, 9]], ["a"], [0.5]

    for given_ in (Result(), {"texts": ["a", " "], "scores": [0.5], "boxes": [[0, 0, 9, 9]]}, {"data": [{"text": "a", "score": 0.5, "bbox": [0, 0, 9, 9]}]}, ([[[[0, 0], [9, 9]], "a", 0.5]], 0.1), [("a", 0.5, [0, 0, 9, 9])], ([[0, 0, 9, 9]], ["a"], [0.5])):
        assert recognition.adapt(given_) == want
    assert recognition.adapt(None) == recognition.adapt(3) == recognition.adapt("x") == []
    assert recognition.item("x", float("nan"), None) == {"text": "x", "confidence": 0.0, "box": []}


def test_engine_failures_stay_in_their_row(spark):
    def engine():
        def call(path):
            if "bad" in path:
                raise RuntimeError("no image")
            return [("hi", 0.9)]

        return call

    rows = spark.createDataFrame([("good",), ("bad",)], "path string").coalesce(1)
    got = {r.path: r for r in recognition.recognise(rows, engine).collect()}
    assert got["good"].raw_items[0].text == "hi" and got["good"].error is None
    assert (got["bad"].error.type, got["bad"].error.message, got["bad"].raw_items) == ("RuntimeError", "no image", [])
    assert recognition.frame_specs(["a/1.png", {"path": "b.png", "time": 7}, ("c.png", 2)], fps=4) == [{"frame": "1.png", "path": "a/1.png", "time": 0.0}, {"frame": "b.png", "path": "b.png", "time": 7.0}, {"frame": "c.png", "path": "c.png", "time": 2.0}]


def test_offset_and_order_flags(spark):
    rows = [("a", 0, 0.2, "x"), ("a", 1, 3.0, "y"), ("a", 2, 1.001, "z"), ("a", 3, 1.004, "w")]
    lines = spark.createDataFrame(rows, "track_id string, ordinal long, start_time_raw double, text string")
    got = {r.text: (r.line_no, r.centiseconds, r.qa_flags) for r in qa.prepare(lines, -500).collect()}
    assert got["x"] == (1, 0, ["negative_offset_clamped"])
    assert got["z"][2] == ["out_of_order_timestamp"] and got["w"][2] == ["duplicate_timestamp"] and got["y"] == (4, 250, [])
    with pytest.raises(Exception):
        qa.prepare(lines, 0, strict=True).collect()


def test_lrc_parse(spark):
    content = "﻿[ti:x]\n[offset:+250]\n\n[00:01.00][00:05.5]first\r\n[00:02:500] second \n[00:03.00]\nplain"
    got = lrc.parse(spark.createDataFrame([("t", content)], "track_id string, content string")).orderBy("line_index").collect()
    assert [(r.timestamp, r.text, r.source_line) for r in got] == [(1.25, "first", 4), (2.75, "second", 5), (5.75, "first", 4)]
    plain = lrc.parse(spark.createDataFrame([("t", content)], "track_id string, content string"), apply_offset=False).first()
    assert plain.timestamp == 1.0


def test_lrc_files(spark, tmp_path):
    rows = [("t", 0, 0.125, 1.0, "中文,歌词", 0.9, 3, ["a", "b"])]
    lines = spark.createDataFrame(rows, "track_id string, ordinal long, start_time_raw double, end_time double, text string, confidence double, support_frames long, qa_flags array<string>")
    assert lrc.write_outputs(lines, tmp_path, dry_run=True)[0]["preview"] == ["[00:00.13]中文,歌词"] and not list(tmp_path.iterdir())
    lrc.write_outputs(lines, tmp_path)
    assert (tmp_path / "t.lrc").read_bytes() == "[00:00.13]中文,歌词\n".encode()
    review = (tmp_path / "t.review.csv").read_bytes().decode()
    assert review.startswith("﻿line_no,") and '1,0.125,0.125,1.000,"中文,歌词",0.9000,3,a;b\n' in review
    with pytest.raises(FileExistsError):
        lrc.write_outputs(lines, tmp_path)
    spark.dataSource.register(lrc.LrcSource)
    back = lrc.parse(spark.read.format("lrc").load(str(tmp_path))).first()
    assert (back.track_id, back.timestamp, back.text) == ("t", 0.13, "中文,歌词")
    spark.createDataFrame([("u", "[00:01.00]x\n")], "track_id string, content string").write.format("lrc").mode("append").save(str(tmp_path))
    assert (tmp_path / "u.lrc").read_text() == "[00:01.00]x\n"
    assert lrc.load(spark, str(tmp_path / "u.lrc")).first().text == "x"


def test_tracks_never_share_a_file(spark, tmp_path):
    tracks = ["a/b", "a_b", "../escaped", "..", "", "x" * 300, "ü", "a b", ".hidden"]
    rows = [(t, 1.0, f"text of {t}") for t in tracks]
    # lines need nothing but a track, a start and a text
    lines = spark.createDataFrame(rows, "track_id string, start_time double, text string")
    done = lrc.write_outputs(lines, tmp_path / "in", force=True)
    files = {p.read_text() for p in (tmp_path / "in").glob("*.lrc")}
    assert len(done) == len({d["lrc"] for d in done}) == len(files) == len(tracks) and [p.name for p in tmp_path.iterdir()] == ["in"]
    spark.dataSource.register(lrc.LrcSource)
    lines.selectExpr("track_id", "text AS content").write.format("lrc").mode("append").save(str(tmp_path / "by"))
    assert {p.read_text() for p in (tmp_path / "by").glob("*.lrc")} == {r[2] for r in rows} and {p.name for p in tmp_path.iterdir()} == {"in", "by"}
    with pytest.raises(ValueError):
        lrc.write_outputs(lines, tmp_path / "one.lrc")
    with pytest.raises(ValueError):
        lrc.LrcReader("s3a://bucket/x").partitions()


def brute_align(ref, cand, least=0.55, gap=0.35):
    """The best key over all order-preserving matchings, tried one by one."""
    n, m, best = len(ref), len(cand), None
    sim = lambda a, b: 1 - slow_distance(a, b) / max(len(a), len(b), 1)
    for k in range(min(n, m) + 1):
        for i in itertools.combinations(range(n), k):
            for j in itertools.combinations(range(m), k):
                pairs = list(zip(i, j))
                if all(ref[a] and cand[b] and sim(ref[a], cand[b]) >= least for a, b in pairs):
                    score = sum(sim(ref[a], cand[b]) for a, b in pairs) - gap * (n + m - 2 * k)
                    key = (round(score, 9), k, sum(ref[a] == cand[b] for a, b in pairs), -round(sum(abs((a + 0.5) / n - (b + 0.5) / m) for a, b in pairs), 9))
                    best = max(best, key) if best else key
    return best


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from(["aaaa", "aaab", "bbbb", "abab", "", "c"]), max_size=4), st.lists(st.sampled_from(["aaaa", "aaab", "bbbb", "abab", "", "c"]), max_size=4))
def test_alignment_is_the_best(ref, cand):
    got = alignment.align(ref, cand)
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:]))
    score = sum(s for *_, s, _ in got) - 0.35 * (len(ref) + len(cand) - 2 * len(got))
    key = (round(score, 9), len(got), sum(d == 0 for *_, d in got), -round(sum(abs((i + 0.5) / len(ref) - (j + 0.5) / len(cand)) for i, j, *_ in got), 9))
    assert key == brute_align(ref, cand)


def lines(spark, rows, track="t"):
    return spark.createDataFrame([(track, i, float(s), t) for i, (s, t) in enumerate(rows)], "track_id string, line_index int, timestamp double, text string")


def test_repeated_chorus():
    ref = ["verse one", "chorus", "verse two", "chorus", "end"]
    assert [(i, j) for i, j, *_ in alignment.align(ref, ["verse one", "chorus", "verse two", "noise zzzzz", "chorus", "end"])] == [(0, 0), (1, 1), (2, 2), (3, 4), (4, 5)]


def test_accuracy(spark):
    ref = lines(spark, [(1, "one"), (2, "two"), (3, "three")])
    total, _ = alignment.evaluate(ref, lines(spark, [(0.5, "one"), (1.5, "two"), (2.5, "three")]))
    r = total.first()
    assert (r.estimated_offset_s, r.residual_median_abs_s, r.line_recall, r.manual_edit_count) == (0.5, 0.0, 1.0, 0)
    total, report = alignment.evaluate(ref, lines(spark, [(0.5, "one"), (1.5, "two"), (2.0, "three")]), Parameters(time_tolerance=0.30))
    r = total.first()
    assert (r.residual_p90_abs_s, r.manual_edit_count) == (0.4, 1)
    total, report = alignment.evaluate(lines(spark, [(1, "abcdefgh"), (2, "ijklmnopq")]), lines(spark, [(1, "abcdefgx"), (2, "ijklmnopq")]))
    r = total.first()
    assert (r.cer, r.manual_edit_rate) == (round(1 / 17, 6), 0.5)
    assert [x.manual_edit_reasons for x in report.orderBy("reference_index").collect()] == [["text"], []]
    total, _ = alignment.evaluate(lines(spark, [(1, "aaaaaa"), (2, "bbbbbb")]), lines(spark, [(1, "aaaaaa"), (2, "cccccc")]))
    r = total.first()
    assert (r.line_recall, r.line_precision, r.manual_edit_rate) == (0.5, 0.5, 1.0)
    total, _ = alignment.evaluate(lines(spark, [(1, "aaaaaa")]), lines(spark, [(1, "zzzzzz")]))
    assert total.first().estimated_offset_s is None
    with pytest.raises(Exception):
        alignment.coerce_lines(lines(spark, [(-1, "x")])).collect()


def test_event_log(spark):
    prefix = event_log.PREFIX
    rows = ["noise", prefix + '{"type":"progress","seq":2,"ratio":0.5}', prefix + '{"event":"completed"}', prefix + "{", prefix + "[1]", prefix + '{"type":3}', prefix + '{"type":"a","event":"b"}', prefix + '{"type":"a","x":"' + "y" * 200 + '"}']
    got = event_log.parse(spark.createDataFrame([(r,) for r in rows], "line string"), most_bytes=150).collect()
    assert [g.issue for g in got] == [None, None, "no JSON", "no object", "no type", "conflicting types", "too long"]
    assert [g.event.type for g in got[:2]] == ["progress", "completed"] and got[0].event.ratio == 0.5
    plain = spark.createDataFrame([("\x1b[31m[WARNING] [engine] The text detection result is empty\x1b[0m",), ("[WARNING] other",)], "l string")
    assert [r[0] for r in plain.select(event_log.routine_warning(F.col("l"), "[engine]")).collect()] == [True, False]


def test_outcomes(spark):
    cases = [(0, False, "completed", True, False, False, "succeeded"), (0, False, "completed", False, False, False, "failed"), (130, False, None, False, False, False, "cancelled"), (1, False, "cancelled", False, True, False, "cancelled"), (1, True, None, False, False, True, "cancelled"), (0, False, "completed", True, False, True, "succeeded"), (1, False, "failed", False, True, False, "failed")]
    got = spark.createDataFrame(cases, "code int, crash boolean, t string, r boolean, e boolean, c boolean, want string").select("want", event_log.outcome(*map(F.col, ("code", "crash", "t", "r", "e", "c"))).alias("got")).collect()
    assert all(g.want == g.got for g in got)


def test_probe(spark):
    payload = {"streams": [{"index": 0, "codec_type": "video", "width": 10, "height": 10, "disposition": {"attached_pic": 1}}, {"index": 2, "codec_type": "video", "codec_name": "h264", "width": 1920, "height": 1080, "avg_frame_rate": "30000/1001", "side_data_list": [{"rotation": -90}]}], "format": {"duration": "123.456", "start_time": "1.25"}}
    got = media.video_info(spark.createDataFrame([(json.dumps(payload),), ('{"streams":[]}',)], "payload string")).collect()
    r = got[0]
    assert (r.stream_index, r.rotation, r.display_width, r.display_height, r.duration, r.duration_source, r.start_time, round(r.average_frame_rate, 3)) == (2, 270, 1080, 1920, 123.456, "format", 1.25, 29.97)
    assert got[1].error == "no video stream"


def test_stage_reuse(spark, tmp_path):
    calls = []

    def once(extra, root=tmp_path):
        settings_ = {"extract": {"fps": 4}, "ocr": {"t": 0.5}, "detector": {"same": 90}, "writer": extra}
        keys = stages.chain_keys(settings_)
        with stages.Run(spark, root, "run", resume=True) as run:
            for name in stages.ORDER:
                run.stage(name, keys[name], lambda name=name: calls.append(name) or spark.range(3))
            return run.folder

    folder = once({"offset": 0})
    assert calls == list(stages.ORDER)
    assert once({"offset": 5}) == folder and calls[4:] == ["writer"]
    path = tmp_path / folder.rpartition("/")[2] / "manifest.json"
    manifest = json.loads(path.read_text())
    assert manifest["attempt"] == 2 and manifest["stages"]["ocr"]["reuse_count"] == 1 and manifest["status"] == "complete"
    path.write_text("{")
    once({"offset": 5})
    assert len(calls) == 9
    with stages.Run(spark, tmp_path, "run", resume=True), pytest.raises(RuntimeError):
        stages.Run(spark, tmp_path, "run", resume=True).__enter__()


def test_output_paths_and_cleaning_are_guarded(spark, tmp_path):
    (tmp_path / "elsewhere").mkdir()
    (tmp_path / "elsewhere/keep").write_text("x")
    with stages.Run(spark, tmp_path / "work", "run") as run:
        inside = tmp_path / "work/run"
        (inside / "frames").mkdir()
        (inside / "frames/000001.png").write_bytes(b"x")
        assert run.clean("frames") and not (inside / "frames").exists() and not run.clean("frames")
        (inside / "frames").symlink_to(tmp_path / "elsewhere")
        for name in ("frames", "..", ".", "a/b", "", "../../elsewhere", "manifest.json"):
            with pytest.raises(ValueError):
                run.clean(name)
        assert (tmp_path / "elsewhere/keep").exists()
        (tmp_path / "link").symlink_to(tmp_path / "work")
        for bad in ("v.mp4", "./v.mp4", "work/run/out.lrc", "work", "link/out.lrc", "elsewhere/../work/x"):
            with pytest.raises(ValueError):
                run.check_output(tmp_path / "v.mp4", tmp_path / bad)
        assert run.check_output(tmp_path / "v.mp4", tmp_path / "out/v.lrc").startswith("file:///")
    with pytest.raises(stages.Cancelled), stages.Run(spark, tmp_path / "work", "run", resume=True) as run:
        raise stages.Cancelled
    assert json.loads((inside / "manifest.json").read_text())["status"] == "cancelled"


def test_decoder_runs_where_the_rows_are(spark, tmp_path):
    import sys

    # stands in for a decoder: writes two frames where its last argument says, or fails
    program = tmp_path / "decoder"
    program.write_text(f"#!{sys.executable}\nimport sys\nif 'bad' in sys.argv[6]:\n    sys.exit('cannot open input')\nfor i in (1, 2):\n    open(sys.argv[-1] % i, 'wb').write(sys.argv[-4].encode())\n")
    program.chmod(0o755)
    (tmp_path / "full").mkdir()
    (tmp_path / "full/000001.png").write_bytes(b"")
    rows = [(f"{n}.mp4", 0, "fps=4", str(tmp_path / f)) for n, f in (("good", "a"), ("bad", "b"), ("good", "full"))]
    jobs = spark.createDataFrame(rows, "path string, stream_index int, filter string, folder string")
    got = {r.folder.rpartition("/")[2]: r for r in media.decode(jobs, str(program)).collect()}
    assert got["a"].error is None and got["b"].error == "cannot open input" and got["full"].error == "the folder holds frames already"
    assert got["a"].arguments[-1].endswith("/a/%06d.png") and "fps=4" in got["a"].arguments
    assert [(r.frame, r.time) for r in media.frames_in(spark, str(tmp_path / "a"), 4).orderBy("frame").collect()] == [("000001.png", 0.0), ("000002.png", 0.25)]
    assert media.decode(jobs, str(tmp_path / "none")).where("error like '%No such file%'").count() == 1
    assert media.run_process([sys.executable, "-c", "import time; time.sleep(9)"], 0.2).startswith("no end")


def test_a_broken_sink_is_told_of():
    def sink(event):
        raise OSError("pipe is gone")

    e = stages.Events(sink, "j")
    with pytest.warns(RuntimeWarning, match="pipe is gone"):
        assert e.emit("progress")["seq"] == 1
    assert isinstance(e.delivery_error, OSError) and e.emit("completed")["seq"] == 2 and e.terminal == "completed"


def test_runner_states_one_by_one(spark):
    rows = [("start", None), ("cancel", None), ("started", None), ("start", None), ("exit", 0), ("cancel", None), ("start", None), ("started", None), ("event", None), ("exit", 0), ("exit", 1)]
    signals = spark.createDataFrame([("j", i, s, c, False, "completed" if i == 8 else None, i == 8, False) for i, (s, c) in enumerate(rows)], "job_id string, seq int, signal string, exit_code int, crashed boolean, terminal_type string, has_result boolean, has_error boolean")
    got = [(r.state, r.accepted) for r in event_log.runner_states(signals).orderBy("seq").collect()]
    assert got == [("starting", True), ("cancelling", True), ("cancelling", True), ("cancelling", False), ("cancelled", True), ("cancelled", False), ("starting", True), ("running", True), ("running", True), ("succeeded", True), ("succeeded", False)]


def test_output_in_pieces():
    line = event_log.PREFIX + '{"type":"é"}'
    raw = f"noise\n{line}\r\n{'x' * 300}\n{event_log.PREFIX}{'y' * 300}\n{line}".encode()
    want = [(line, None), (None, "too long"), (line, None)]
    for size in (1, 2, 3, 7, 64, 1000):
        cutter = event_log.Lines(most_bytes=100)
        got = [x for i in range(0, len(raw), size) for x in cutter.feed(raw[i : i + size])]
        assert len(cutter.held) <= 100 and got + cutter.finish() == want and cutter.finish() == []
    cutter = event_log.Lines()
    assert cutter.feed(event_log.PREFIX.encode() + b"\xff\n") == [(None, "no UTF-8")] and cutter.feed(b"") == []
    with pytest.raises(ValueError):
        event_log.Lines(most_bytes=5)


def test_control_sequences(spark):
    rows = ["\x1b[31mred\x1b[0m", "a\x1b]0;title\x07b", "a\x1b]8;;http://x\x1b\\b", "\x9b1mx", "\x1b(Bx\x1b=y", "\x1bPq#0\x1b\\z", "plain [31m", "\x1b[?25l\x1b[2K\x1b[1;31;40mx"]
    got = [r.t for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").orderBy("i").select(event_log.strip_ansi(F.col("t")).alias("t")).collect()]
    assert got == ["red", "ab", "ab", "x", "xy", "z", "plain [31m", "x"]


def test_engines_of_any_kind(spark):
    class Runs:
        def run(self, path, text_score=0.9):
            return [(f"{path}{text_score}", 0.9)]

    class Calls:
        def __call__(self, path):
            return [(path, 0.8)]

    assert recognition.entry_of(Runs(), 0.1)("a") == [("a0.1", 0.9)] and recognition.entry_of(Runs())("a") == [("a0.9", 0.9)]
    assert recognition.entry_of(Calls(), 0.1)("a") == [("a", 0.8)] and recognition.entry_of(lambda p, **kw: kw, 0.2)("a") == {"text_score": 0.2}
    with pytest.raises(TypeError):
        recognition.entry_of(object())
    with pytest.raises(ValueError):
        recognition.entry_of(Calls(), 2.0)
    # an engine that cannot be used is an error of each frame, not of the job
    got = recognition.recognise(spark.createDataFrame([("x",)], "path string"), object).first()
    assert got.error.type == "TypeError" and got.raw_items == []


def test_events_and_cancellation(tmp_path):
    sent = []
    e = stages.Events(sent, "j")
    e.emit("progress", type="x", seq=9)
    e.emit("completed")
    assert e.emit("failed") is None and [(s["type"], s["seq"]) for s in sent] == [("progress", 1), ("completed", 2)]
    stop = stages.Cancellation(tmp_path / "stop")
    stop.check()
    (tmp_path / "stop").touch()
    with pytest.raises(stages.Cancelled):
        stop.check()


def test_fingerprints_and_jobs(spark, tmp_path):
    import hashlib

    (tmp_path / "f").write_bytes(b"abc")
    assert media.fingerprints(spark, str(tmp_path / "f")).first().sha256 == hashlib.sha256(b"abc").hexdigest()
    assert stages.stable_hash({"b": 1, "a": 2}) == stages.stable_hash({"a": 2, "b": 1})
    assert short_number(0.1 + 0.2) == "0.3"
    size = media.fingerprint(spark, str(tmp_path / "f"))["size"]
    assert size == 3
    listed = media.listing(spark, str(tmp_path))
    (tmp_path / "f").write_bytes(b"abcd")
    assert media.listing(spark, str(tmp_path)) != listed
    from verseline.plans import cli

    jobs = [Job("v.mp4"), Job("v.mp4", "o", Parameters(offset_ms=-5, roi=(0, 0, 1, 0.5), style="auto", fps=29.97, workers=2), "w", True, True, True, True), Job("v", parameters=Parameters(crop_bottom_ratio=0.25, max_blank_frames=0, line_tolerance=0.5, raw_score_floor=0.2))]
    for job in jobs:
        a = cli.parser().parse_args(job.arguments(job_id="x", cancel_file=tmp_path / "c", preview=job.force))
        assert cli.parameters(a) == job.parameters and (a.frames, cli.target(a)) == (str(job.source), str(job.target))
        assert (a.force, a.resume, a.strict, a.keep_workdir, a.preview_roi, a.job_id, a.event_stream, a.cancel_file) == (job.force, job.resume, job.strict, job.keep_workdir, job.force, "x", True, str(tmp_path / "c"))
        assert a.workdir == (str(job.workdir) if job.workdir else None)
    with pytest.raises(ValueError):
        Job("v.mp4", resume=1)
    with pytest.raises(ValueError):
        Job("v.mp4", "v.mp4")


def test_command_line(spark, tmp_path, capsys):
    from verseline.plans import cli

    rows = [("t", i, i / 4, t, 0.9) for i, t in enumerate(["hello there"] * 3 + ["good bye now"] * 3)]
    spark.createDataFrame(rows, "track_id string, source_index long, time double, text string, confidence double").write.parquet(str(tmp_path / "frames"))
    assert cli.main(["detect", str(tmp_path / "frames"), str(tmp_path / "out")]) == 0
    assert (tmp_path / "out/t.lrc").read_text() == "[00:00.00]hello there\n[00:00.75]good bye now\n"
    assert cli.main(["detect", str(tmp_path / "frames"), str(tmp_path / "out")]) == 2
    capsys.readouterr()
    run = ["detect", str(tmp_path / "frames"), "-o", str(tmp_path / "one.lrc"), "--workdir", str(tmp_path / "work"), "--resume", "--event-stream", "--force"]
    for reused in (False, True):
        assert cli.main(run) == 0
        out = capsys.readouterr().out
        told = [json.loads(x.removeprefix(event_log.PREFIX)) for x in out.splitlines() if x.startswith(event_log.PREFIX)]
        assert [t["type"] for t in told] == ["stage_started", "stage_completed"] * 3 + ["completed"] and told[1]["reused"] == reused
    assert (tmp_path / "one.lrc").read_text().startswith("[00:00.00]hello there")
    assert cli.main([*run[:2], "-o", str(tmp_path / "work/x.lrc"), "--workdir", str(tmp_path / "work")]) == 2
    assert cli.main(["detect", str(tmp_path / "frames"), str(tmp_path / "p"), "--preview-roi", "--roi", "0,0.5,1,0.5"]) == 0
    shown = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert shown["roi"] == [0, 0.5, 1, 0.5] and len(shown["times"]) == 6
    assert cli.main(["evaluate", str(tmp_path / "out/t.lrc"), str(tmp_path / "out/t.lrc"), "--compact"]) == 0
    assert json.loads(capsys.readouterr().out)["line_recall"] == 1.0
    # two rows on screen: which one is read is a choice
    box = lambda top: [[0.0, top], [90.0, top], [90.0, top + 10], [0.0, top + 10]]
    items = [{"text": "upper row", "confidence": 0.9, "box": box(0.0)}, {"text": "lower row", "confidence": 0.95, "box": box(50.0)}]
    spark.createDataFrame([("t", i, i / 4, items) for i in range(3)], f"track_id string, source_index long, time double, raw_items array<{ITEM}>").write.parquet(str(tmp_path / "items"))
    for row in ("top", "bottom"):
        assert cli.main(["detect", str(tmp_path / "items"), str(tmp_path / row), "--active-row", row]) == 0
    assert (tmp_path / "top/t.lrc").read_text() == "[00:00.00]upper row\n" and (tmp_path / "bottom/t.lrc").read_text() == "[00:00.00]lower row\n"
    (tmp_path / "stop").touch()
    assert cli.main(["detect", str(tmp_path / "frames"), str(tmp_path / "out2"), "--cancel-file", str(tmp_path / "stop")]) == 130


def test_number_cleaning(spark):
    row = spark.createDataFrame([("50",), ("nan",), ("x",), ("-1",), (None,)], "v string")
    got = row.select(numbers.observed_confidence(F.col("v"), F.lit(0.25)).alias("a"), numbers.recognised_confidence(F.col("v")).alias("b"), numbers.clean(F.lit(1e-9)).alias("c")).collect()
    assert [(g.a, g.b) for g in got] == [(0.5, 50.0), (0.25, 0.0), (0.25, 0.0), (0.0, -1.0), (0.25, 0.0)] and got[0].c == 0.0
