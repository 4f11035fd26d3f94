import io
import struct
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.sources import files as S
from cohortloom.sources import sinks as W


def test_events(spark, tmp_path):
    (tmp_path / "ev").mkdir()
    (tmp_path / "ev" / "a.tsv").write_text("﻿onset\tduration\ttrial_type\tvalue\tsample\n0.1\t0\tROWS \tROWS\t25\n0.1\t0\tROWE\t\t25\n", encoding="utf-8")
    rows = S.read_events(spark, str(tmp_path / "ev")).orderBy("ord").collect()
    assert [(r.sample, r.ord, r.trial_type, r.value) for r in rows] == [(25, 0, "ROWS", "ROWS"), (25, 1, "ROWE", None)]
    assert S.read_events(spark, str(tmp_path / "none")).count() == 0


def _xlsx(cells):
    sheet = "".join(f'<c r="{ref}" t="{t}">{body}</c>' for ref, t, body in cells)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>text</t></si><si><r><t>序</t></r><r><t>言</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData><row>{sheet}</row></sheetData></worksheet>")
    return out.getvalue()


def test_workbook(spark, tmp_path):
    cells = [("A1", "s", "<v>0</v>"), ("A2", "s", "<v>1</v>"), ("A4", "n", "<v>1</v>"), ("A5", "inlineStr", "<is><t>你好。</t></is>"), ("E5", "str", "<v>f1ch1</v>"), ("B5", "b", "<v>1</v>"), ("C5", "n", "<v>2.5</v>")]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "b.xlsx").write_bytes(_xlsx(cells))
    (tmp_path / "x" / "bad.xlsx").write_bytes(b"no zip")
    df = S.read_xlsx(spark, str(tmp_path / "x"))
    got = {(r.row, r.column): r.value for r in df.where("error IS NULL").collect()}
    assert got[2, 1] == "序言" and got[4, 1] == "1" and got[5, 2] == "TRUE" and got[5, 3] == "2.5"
    assert df.where("error IS NOT NULL").count() == 1
    units = S.text_units(df).orderBy("row").collect()
    assert [(r.row, r.is_marker, r.chapter, r.unit) for r in units] == [(2, False, 0, "ch00:row0001"), (4, True, 1, None), (5, False, 1, "ch01:row0001")] and units[2].start_label == "f1ch1"


def test_headers_audio_and_signals(spark, tmp_path):
    d = tmp_path / "rec"
    d.mkdir()
    (d / "sub-1_ses-a_task-t_run-2_eeg.vhdr").write_text("Brain Header\n[Common Infos]\nDataFile=gone.eeg\nMarkerFile=m.vmrk\nNumberOfChannels=2\nSamplingInterval=4000\n[Binary Infos]\nBinaryFormat=IEEE_FLOAT_32\n[Channel Infos]\nCh1=E1,,1\nCh2=E2,,1\n")
    data = np.arange(10, dtype="<f4")
    (d / "sub-1_ses-a_task-t_run-2_eeg.eeg").write_bytes(data.tobytes() + b"xx")
    with wave.open(str(d / "a.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(struct.pack("<8h", *range(8)))
    h = S.read_headers(spark, str(d / "*.vhdr"), S.discover(spark, str(d))).first()
    assert (h.rate, h.channels, h.channel_names, h.n_times, h.remainder, h.broken_reference) == (250.0, 2, "E1|E2", 5, 2, True)
    a = S.read_wav_info(spark, str(d / "*.wav")).first()
    assert (a.frames, a.rate, a.channels, a.seconds) == (4, 8000, 2, 0.0005)
    assert S.mono([1, 3, 5, 7], 2).tolist() == [2, 6]
    (d / "sig.eeg").write_bytes(data.tobytes())
    seg = S.read_signal_segments(spark.createDataFrame([(str(d / "sig.eeg"), 1, 3), (str(d / "sig.eeg"), 4, 9)], "path string, start int, stop int"), 2).collect()
    assert seg[0].values == [2, 3, 4, 5] and seg[1].values is None and "outside" in seg[1].error


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", None)], "id string, n int")
    W.write_jsonl(df, str(tmp_path / "j1"), "id", single=True)
    W.write_jsonl(df.orderBy(F.desc("id")), str(tmp_path / "j2"), "id", single=True)
    text = lambda p: "".join(x.read_text() for x in sorted((tmp_path / p).glob("part*")))
    assert text("j1") == text("j2") == '{"id":"a","n":null}\n{"id":"b","n":2}\n'
    assert S.read_jsonl(spark, str(tmp_path / "j1"), "id string, n int").count() == 2
    with pytest.raises(ValueError):
        S.read_jsonl(spark, str(tmp_path / "j1"), "id string, n int", "v2", "id")
    W.write_manifest(df, str(tmp_path / "m"), str(tmp_path / "c"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).count() == 2
    with pytest.raises(Exception, match="(?i)exists"):
        W.write_manifest(df, str(tmp_path / "m"))
    assert W.write_json({"b": 1, "a": "文"}, str(tmp_path / "x.json")) == W.write_json({"a": "文", "b": 1}, str(tmp_path / "x.json"))
    run = lambda: W.extend_index(spark, df, str(tmp_path / "idx"), "id", lambda x: x.select("id", F.lit(1).alias("f")))
    assert run() == {"existing": 0, "extracted": 2} and run() == {"existing": 2, "extracted": 0}
    fitted = spark.createDataFrame([("r", 1.0, 2.0)], "k string, center double, scale double")
    W.save_scaler(fitted, str(tmp_path / "s"), "robust")
    assert W.load_scaler(spark, str(tmp_path / "s"), "robust").first().scale == 2.0
    with pytest.raises(ValueError):
        W.load_scaler(spark, str(tmp_path / "s"), "standard")
    assert W.markdown_table([{"a": 1, "b": None}], ["a", "b"]) == "| a | b |\n|---|---|\n| 1 |  |\n" and len(W.normalization_rules()["rules"]) == 7
    (tmp_path / "o.csv").write_text(",".join(S.OVERRIDES) + "\na,b,manual,x,y\n")
    assert S.read_overrides(spark, str(tmp_path / "o.csv")).count() == 1
    (tmp_path / "p.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        S.read_overrides(spark, str(tmp_path / "p.csv"))
    assert S.read_overrides(spark, str(tmp_path / "new.csv"), create=True).count() == 0
    (tmp_path / "q.csv").write_text(",".join(S.OVERRIDES) + "\n,b,manual,x,y\n")
    with pytest.raises(ValueError):
        S.read_overrides(spark, str(tmp_path / "q.csv"))


def test_strict_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeffid,text\n1,"a, ""b"""\n2,\n', encoding="utf-8")
    assert [tuple(r) for r in S.read_csv(spark, str(tmp_path / "a.csv"), ["id", "text"]).orderBy("id").collect()] == [("1", 'a, "b"'), ("2", None)]
    with pytest.raises(ValueError):
        S.read_csv(spark, str(tmp_path / "a.csv"), ["id"])
    (tmp_path / "b.csv").write_text("id,text\n1,a,more\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        S.read_csv(spark, str(tmp_path / "b.csv"), ["id", "text"]).collect()


def test_sheets_in_the_order_of_the_workbook():
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><sheets><sheet name="b" r:id="x2"/><sheet name="a" r:id="x1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="x1" Target="worksheets/sheet1.xml"/><Relationship Id="x2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        for i in (1, 2):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet {ns}><sheetData><row><c r="A1"><v>{i}</v></c></row></sheetData></worksheet>')
    assert S.xlsx_cells(out.getvalue()) == [(1, 1, "2")] and S.xlsx_cells(out.getvalue(), 1) == [(1, 1, "1")]
    with pytest.raises(ValueError):
        S.xlsx_cells(out.getvalue(), 2)


def test_audio_blocks(spark, tmp_path):
    for name, width in (("two", 2), ("three", 3)):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setnchannels(2), w.setsampwidth(width), w.setframerate(10)
            w.writeframes(b"".join(int(x * 2 ** (8 * width - 1)).to_bytes(width, "little", signed=True) for i in range(20) for x in (i / 64, -i / 32)))
    rows = [(str(tmp_path / f"{n}.wav"), a, z) for n in ("two", "three") for a, z in ((0.5, 0.8), (1.5, 2.0), (1.5, 2.2), (0.3, 0.3))]
    got = S.read_audio_blocks(spark.createDataFrame(rows, "path string, start_sec double, stop_sec double")).collect()
    assert len(got) == 8
    for r in got:
        a, z = round(r.start_sec * 10), round(r.stop_sec * 10)
        if r.error:
            assert z > 20 or a == z
        else:
            assert np.allclose(r.asDict()["values"], [-i / 128 for i in range(a, z)], atol=1e-4)
    assert sum(bool(r.error) for r in got) == 4


def test_stores_features_reports_and_trees(spark, tmp_path):
    import hashlib

    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "id string, values array<double>")
    W.write_arrays(df, str(tmp_path / "store"), {"model": "m"}, 2)
    assert W.read_arrays(spark, str(tmp_path / "store"), {"model": "m"}).count() == 2
    for bad in ([None], [[]], [[1.0]], [[1.0, float("nan")]]):
        with pytest.raises(ValueError):
            W.write_arrays(spark.createDataFrame([("c", *bad)], "id string, values array<double>"), str(tmp_path / "no"), length=2)
    with pytest.raises(ValueError):
        W.read_arrays(spark, str(tmp_path / "store"), {"model": "other"})
    (tmp_path / "f.jsonl").write_text('{"id":"a","text":"x"}\n\n{"id":"b","text":"y"}\n')
    assert S.read_features(spark, str(tmp_path / "f.jsonl"), "id string, text string", "id", ["text"]).count() == 2
    for body in ('{"id":"a"}\n', '{"id":"a","text":"x"}\n{"id":"a","text":"y"}\n'):
        (tmp_path / "g.jsonl").write_text(body)
        with pytest.raises(ValueError):
            S.read_features(spark, str(tmp_path / "g.jsonl"), "id string, text string", "id", ["text"])
    W.audit_report("Audit", {"Rows": spark.createDataFrame([(2, "b"), (1, "a|c")], "n int, t string")}, str(tmp_path / "r.md"))
    assert (tmp_path / "r.md").read_text() == "# Audit\n\n## Rows\n\n| n | t |\n|---|---|\n| 1 | a\\|c |\n| 2 | b |\n"
    with pytest.raises(ValueError):
        W.audit_report("Audit", {"Rows": spark.range(9)}, str(tmp_path / "r.md"), most=8)
    (tmp_path / "tree" / "x").mkdir(parents=True)
    (tmp_path / "tree" / "b.txt").write_text("B"), (tmp_path / "tree" / "x" / "a.txt").write_text("A")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert S.tree_digest(spark, str(tmp_path / "tree")) == sha(f"b.txt|{sha('B')}\nx/a.txt|{sha('A')}\n")


def test_runs_from_a_configuration(spark, tmp_path, monkeypatch):
    import json

    from cohortloom import run as R
    from cohortloom.plans import catalog

    monkeypatch.setattr(catalog, "queries", lambda: {"one": lambda s, d: s.range(3)})
    (tmp_path / "c.json").write_text(json.dumps({"tables": "t", "output": str(tmp_path / "out"), "queries": ["one"], "windows": {"window_sec": 2.0}}))
    config = R.RunConfig.read(str(tmp_path / "c.json"))
    assert config.windows.window_sec == 2.0 and spark.read.parquet(R.run(spark, config)["one"]).count() == 3
    with pytest.raises(Exception, match="(?i)exists"):
        R.run(spark, config)
    for bad in ({"queries": ("none",)}, {"surplus": 1}):
        with pytest.raises(ValueError):
            R.run(spark, R.RunConfig.read(str(tmp_path / "c.json"), **bad))
    with pytest.raises(ValueError):
        R.WindowConfig(window_sec=0)
