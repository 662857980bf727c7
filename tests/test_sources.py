import json

import pytest

from tidemark import cli
from tidemark.sources import adapters, frames, index, titles
from tidemark.streaming.sampler import streaming_sample
from tests.test_segments import recording


def write_recording(path, rows, speech=()):
    with path.open("w") as f:
        f.write(json.dumps({"duration_sec": rows[-1][3] + 1, "has_audio": bool(speech), "speech": list(speech)}) + "\n")
        for _, _, i, t, v, text, _ in rows:
            f.write(json.dumps({"pts": int(t * 10), "time_base": 0.1, "image": {"vector": v, "lines": [[x, 0.9] for x in text.split()] + [["noise", 0.1]]}}) + "\n")


def test_command_line(spark, tmp_path, capsys):
    rows, bounds = recording("clip", [30, 40, 35])
    video = tmp_path / "clip.jsonl"
    write_recording(video, rows, [(0.0, 5.0, " hello "), (6.0, 7.0, "  ")])
    assert cli.main(["chapters", str(tmp_path / "none.jsonl")]) == 2
    assert cli.main(["chapters", str(video), "--chapters", "3"]) == 0
    out = json.loads((tmp_path / "clip.events.json").read_text())
    starts = [e["start_time"] for e in out["events"]]
    assert len(starts) == 3 and all(abs(a - b) <= 1 for a, b in zip(starts[1:], bounds))
    assert out["events"][0]["transcript_text"] == "hello" and "noise" not in out["events"][0]["ocr_text"]
    assert out["extra"]["channels"] == ["dense", "screen"] and out["extra"]["n_samples"] == 105
    assert cli.main(["label", str(tmp_path / "clip.events.json")]) == 0
    again = json.loads((tmp_path / "clip.events.json").read_text())
    assert "extra" not in again and [e["title"] for e in again["events"]] == [e["title"] for e in out["events"]]
    assert "0:00 " in capsys.readouterr().out
    empty = tmp_path / "empty.jsonl"
    empty.write_text("{}\n")
    assert cli.main(["chapters", str(empty)]) == 1


def test_frame_source(spark, tmp_path):
    rows, _ = recording("a", [4])
    write_recording(tmp_path / "a.jsonl", rows)
    write_recording(tmp_path / "b.jsonl", rows[:2])
    frames.register(spark)
    df = spark.read.format("video_frames").option("path", str(tmp_path / "*.jsonl")).load()
    assert sorted((r.video_id, r.frame_idx, r.pts, round(r.time_sec, 6)) for r in df.collect()) == [("a", i, i * 10, float(i)) for i in range(4)] + [("b", i, i * 10, float(i)) for i in range(2)]
    assert df.where("frame_idx <= 1").count() == 4


def test_frame_index_cache(spark, tmp_path):
    rows, _ = recording("a", [4])
    write_recording(tmp_path / "a.jsonl", rows)
    cache = str(tmp_path / "cache")
    for want in (4, 4):
        assert frames.frame_index(spark, str(tmp_path / "*.jsonl"), cache_dir=cache).count() == want
    assert len([p for p in (tmp_path / "cache").iterdir()]) == 1
    write_recording(tmp_path / "a.jsonl", rows[:2])
    assert frames.frame_index(spark, str(tmp_path / "*.jsonl"), cache_dir=cache).count() == 2


def test_request_content(spark, tmp_path):
    rows, _ = recording("a", [6])
    write_recording(tmp_path / "a.jsonl", rows)
    events = spark.createDataFrame([("a", "0000", 0.0, 3.0, "x", "", [0, 1, 2]), ("a", "0001", 3.0, 6.0, "", "", [3, 99])], "video_id string, event_id string, start_time double, end_time double, ocr_text string, transcript_text string, sample_indices array<int>")
    videos = spark.createDataFrame([("a", str(tmp_path / "a.jsonl"))], "video_id string, path string")
    images = titles.event_images(events, videos, reader="tidemark.sources.adapters:JsonFrames", encoder="tidemark.sources.titles:StubEncoder")
    assert sorted((r.event_id, r.n) for r in images.collect()) == [("0000", 0), ("0000", 1), ("0001", 0)]
    content = titles.request_content(events, images).first().content
    assert [b.kind for b in content] == ["text", "text", "image", "image", "text", "image"]
    assert content[1].data.startswith("[0000] 0:00-0:03 (3s)") and content[4].data.endswith("(no text evidence)")
    titles.write_patches(spark.createDataFrame([("p.bin", bytearray(b"12"))], "name string, data binary"), f"file://{tmp_path}/patches")
    assert (tmp_path / "patches" / "p.bin").read_bytes() == b"12"


def test_index_files(spark, tmp_path):
    event = {"event_id": "0000", "start_frame": 0, "end_frame": 3, "start_time": 0.0, "end_time": 4.0, "title": "ü", "odd": 1, "metadata": {"boundary_score": None, "n_samples": 4}}
    payload = {"video_id": "v", "video_path": "/v", "duration_sec": 4.0, "events": [event], "extra": {}}
    path = tmp_path / "x" / "v.json"
    index.write_index(path, payload)
    assert "extra" not in json.loads(path.read_text()) and "ü" in path.read_text()
    assert "odd" not in index.read_payload(path)["events"][0]
    assert index.read_index(spark, str(path)).first().events[0].title == "ü"
    with pytest.raises(TypeError):
        index.write_index(path, {**payload, "events": [object()]})
    assert [p.name for p in path.parent.iterdir()] == ["v.json"]
    path.write_text(json.dumps({**payload, "events": [{"event_id": "0000"}]}))
    with pytest.raises(ValueError):
        index.read_payload(path)
    with pytest.raises(Exception, match="required field"):
        index.read_index(spark, str(path)).collect()
    path.write_text(json.dumps({"video_id": "v"}))
    assert index.read_index(spark, str(path)).first().events == []


def test_title_backends(spark):
    events = spark.createDataFrame([("v", "0000", "alpha alpha", "", 0.0, 1.0)], "video_id string, event_id string, ocr_text string, transcript_text string, start_time double, end_time double")
    prompts = spark.createDataFrame([("v", "0000", "p")], "video_id string, event_id string, prompt string")

    def fail(_):
        raise RuntimeError("no answer")

    for kind, model, want in (("auto", lambda p: [(e, "given") for e, _ in p], ("given", "model")), ("auto", fail, ("alpha", "heuristic")), ("other", None, ("alpha", "heuristic"))):
        made, used = adapters.titles(events, prompts, backend=kind, model=model)
        assert (made.first().title, used) == want
    assert adapters.titles(events, prompts, enabled=False)[1] == "none"


def test_stream_survives_a_restart(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "video_id string, frame_idx long, time_sec double, text string"
    batches = [[("v", 0, 0.0, "a"), ("v", 1, 0.5, None)], [("v", 2, 1.2, None), ("v", 3, 1.9, "b"), ("w", 0, 0.1, None)], [("v", 4, 2.3, None)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = streaming_sample(spark.readStream.schema(schema).parquet(source), interval=1.0, text="text")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.video_id, r.frame_idx, r.carried) for r in spark.read.parquet(out).collect())
    assert got == [("v", 0, "a"), ("v", 2, "a"), ("v", 4, "a"), ("w", 0, "")]
