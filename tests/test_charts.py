"""Chart extraction, path resolution and symbolic coverage against truth tables and enumeration."""

import json

import pytest

from kinfold.functions import python as P
from kinfold.operators import compare, extract, resolve
from kinfold.operators.symbolic import COVERED, UNCLEAR


def parse(text, ext="bms", **limits):
    return extract.parse_chart(text if isinstance(text, bytes) else text.encode(), ext, extract.Limits(**limits))


def song(*lines, **limits):
    return parse("\n".join(lines), **limits)


def codes(r):
    return {d["code"] for d in r["diagnostics"]}


def test_whole_song():
    r = song("#ARTIST nobody", "// drums", "#WAV0A drums/kick 1.wav", "#bmp7Z\tsky.png", "#BPM0C 97.5", "#STOP02 48", "  #02301:0A000A", "#02314:000A", "#02306:7Z", "#02308:0C", "#02309:0002", "#02302:0.75", "#STAGEFILE cover.jpg")
    assert [(d["namespace"], d["logical_id"], d["kind"], d["written_path"], d["value"], d["line"]) for d in r["declarations"]] == [
        ("WAV", "0A", "AUDIO", "drums/kick 1.wav", "drums/kick 1.wav", 3), ("BMP", "7Z", "VISUAL", "sky.png", "sky.png", 4), ("BPM", "0C", "TIMING", None, "97.5", 5), ("STOP", "02", "TIMING", None, "48", 6), ("HEADER", "STAGEFILE", "VISUAL", "cover.jpg", "cover.jpg", 13),
    ]
    assert [(u["logical_id"], u["kind"], u["line"], u["column"]) for u in r["usages"]] == [("0A", "BGM_EVENT", 7, 10), ("0A", "BGM_EVENT", 7, 14), ("0A", "PLAYABLE_EVENT", 8, 10), ("7Z", "BGA_06", 9, 8), ("0C", "TIMING_REFERENCE", 10, 8), ("02", "TIMING_REFERENCE", 11, 10), ("STAGEFILE", "HEADER_RESOURCE", 13, None)]
    assert (r["diagnostics"], r["coverage"]) == ([], "COMPLETE_SUPPORTED_SYNTAX")


def test_ids_declared_twice():
    r = song("#WAVAA one.wav", "#WAVBB two.wav", "#WAVAA three.wav", "#WAVCC four.wav", "#WAVCC four.wav", "#00511:AABBCCDD")
    assert {"CONFLICTING_DECLARATIONS", "DUPLICATE_DECLARATION", "UNDECLARED_LOGICAL_ID"} <= codes(r)
    assert [u["state"] for u in r["usages"]] == ["AMBIGUOUS", "POTENTIAL", "AMBIGUOUS", "UNKNOWN"] and [d["state"] for d in r["declarations"]].count("OBSERVED") == 1


@pytest.mark.parametrize(
    "raw,encodings,code",
    [("#ARTIST 歌".encode("cp932"), ["CP932"], None), ("#ARTIST über".encode(), ["UTF-8", "CP932"], "AMBIGUOUS_ENCODING"), (b"#GENRE \xfe\xff\x81", [], "DECODING_FAILED"), (b"\xef\xbb\xbf#GENRE \xe3\x81", [], "DECODING_FAILED"), (b"#GENRE x\0y", ["UTF-8"], "NUL_IN_TEXT")],
)
def test_decodings(raw, encodings, code):
    r = parse(raw)
    assert [d["encoding"] for d in r["decodings"]] == encodings and (code is None or code in codes(r))


def test_decoded_paths():
    r = parse("#WAV0B 歌/こえ.wav".encode("cp932"))
    assert r["declarations"][0]["written_path"] == "歌/こえ.wav"


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_line_ends(end):
    r = parse(end.join(["#WAV01 p.wav", "", "#00111:01", ""]))
    assert (r["declarations"][0]["line"], r["usages"][0]["line"], r["diagnostics"]) == (1, 3, [])


@pytest.mark.parametrize(
    "lines,code",
    [
        (["#RANDOM 3", "#IF 2", "#ENDRANDOM"], "UNCLOSED_CONDITIONAL"), (["#RANDOM 2", "#ELSEIF 1"], "ORPHAN_BRANCH"), (["#RANDOM 2", "#DEF"], "ORPHAN_CASE"), (["#SETSWITCH 4", "#CASE 4", "#ENDRANDOM"], "MISMATCHED_CONDITIONAL_END"), (["#SWITCH 0"], "INVALID_CONDITIONAL_ARGUMENT"), (["#SETRANDOM 2147483648"], "INVALID_CONDITIONAL_ARGUMENT"),
        (["#MIDIFILE m.mid"], "UNSUPPORTED_SYNTAX"), (["some words"], "UNSUPPORTED_SYNTAX"), (["#BMP123 a.png"], "MALFORMED_DECLARATION"), (["#BMP0F   "], "EMPTY_RESOURCE_PATH"), (["#07702:1.2.3"], "MALFORMED_METER"), (["#07702:0.0"], "MALFORMED_METER"), (["#07716:0AB"], "MALFORMED_EVENT_DATA"),
        (["#07703:7G"], "INVALID_HEX_BPM"), (["#07701:0-"], "UNSUPPORTED_SYNTAX"), (["#RANDOM 5", "#ENDRANDOM"], "CONDITIONAL_SEMANTICS_DEFERRED"), (["#LNOBJ ZZ"], "LN_SEMANTICS_DEFERRED"),
    ],
)
def test_diagnostics(lines, code):
    assert code in codes(song(*lines))


def test_channels():
    r = song("#100E9:7X", "#10042:7X", "#10065:7X", "#10007:7X", "#10003:0F", "#100Q4:7X", "#LNOBJ 7x")
    assert [(u["namespace"], u["logical_id"], u["kind"]) for u in r["usages"]] == [("WAV", "00", "LANDMINE_WAV00_POTENTIAL"), ("WAV", "7X", "INVISIBLE_EVENT"), ("WAV", "7X", "LONG_NOTE_EVENT"), ("BMP", "7X", "BGA_07"), ("WAV", "7X", "LN_TERMINATOR_MARKER")]
    assert [u["kind"] for u in r["unknown"]] == ["CHANNEL_Q4"]
    other = song("#base 62", "#WAVzz z.wav", "#10011:ZZ")
    assert [u["state"] for u in other["usages"]] == ["UNKNOWN"] and other["declarations"][0]["state"] == "UNSUPPORTED" and other["usages"][0]["logical_id"] is None


def test_blocks():
    r = song("#RANDOM 2", "#IF 1", "#WAV01 a", "#ELSEIF 2", "#WAV01 b", "#ELSE", "#WAV01 c", "#ENDIF", "#SWITCH 2", "#CASE 1", "#SKIP", "#DEF", "#WAV02 d", "#ENDSW", "#ENDRANDOM", "#WAV03 e")
    assert [(c["directive"], c["parent"]) for c in r["contexts"]] == [("RANDOM", None), ("IF", 0), ("ELSEIF", 0), ("ELSE", 0), ("ENDIF", 3), ("SWITCH", 0), ("CASE", 5), ("SKIP", 6), ("DEF", 5), ("ENDSW", 8), ("ENDRANDOM", 0)]
    assert [d["contexts"] for d in r["declarations"]] == [[0, 1], [0, 2], [0, 3], [0, 5, 8], []]


def test_limits():
    assert "LINE_LIMIT" in codes(song("#GENRE " + "y" * 90, line=30)) and "FACT_OR_DEPTH_LIMIT" in codes(song("#04511:" + "0A" * 70, facts=20))
    r = song("#GENRE waltz", bytes=4)
    assert codes(r) == {"SIZE_LIMIT"} and r["sha256"] is None
    assert "FACT_OR_DEPTH_LIMIT" in codes(song(*["#RANDOM 3"] * 7, depth=6)) and "FACT_OR_DEPTH_LIMIT" not in codes(song(*["#RANDOM 3"] * 6, depth=6))
    assert codes(parse("")) == {"EMPTY_CHART"} and codes(parse("x", "doc")) == {"FORMAT_UNSUPPORTED"}
    many = song(*["what"] * 30, facts=20)
    assert len(many["unknown"]) == 20 == len(many["diagnostics"]) and many["diagnostics"][-1]["code"] == "FACT_OR_DEPTH_LIMIT"
    with pytest.raises(ValueError):
        extract.Limits(depth=65)


NOTE = {"x": 0, "y": 0, "l": 0, "c": False}


def chart(**changes):
    return {
        "version": "1.0.0", "info": {"back_image": "b.png", "banner_image": "c.png"}, "sound_channels": [{"name": "a.wav", "notes": [NOTE, NOTE | {"x": 1, "y": 240, "l": 2**32 - 1, "c": True}, NOTE | {"x": None}]}],
        "bga": {"bga_header": [{"id": 1, "name": "m.mp4"}], "bga_events": [{"id": 1, "y": 0}]}, "bpm_events": [{"y": 0, "bpm": 1.5}],
    } | changes


def test_json_chart():
    r = parse(json.dumps(chart()), "bmson")
    assert [(d["namespace"], d["logical_id"], d["pointer"]) for d in r["declarations"]] == [("BMSON_INFO", "back_image", "/info/back_image"), ("BMSON_INFO", "banner_image", "/info/banner_image"), ("BMSON_SOUND", "0", "/sound_channels/0/name"), ("BMSON_BGA", "1", "/bga/bga_header/0/name")]
    assert [u["kind"] for u in r["usages"]] == ["HEADER_RESOURCE", "HEADER_RESOURCE", "BGM_EVENT", "PLAYABLE_EVENT", "BGM_EVENT", "BGA_EVENTS"] and (r["diagnostics"], r["coverage"]) == ([], "COMPLETE_SUPPORTED_SYNTAX")
    played = r["usages"][3]
    assert (played["lane"], played["pulse"], played["length"], played["continuation"], played["pointer"]) == ("1", 240, 2**32 - 1, True, "/sound_channels/0/notes/1") and r["usages"][4]["lane"] == "null"


@pytest.mark.parametrize(
    "value,code,pointer",
    [
        (chart(version="0.9"), "BMSON_VERSION_UNSUPPORTED", "/version"), (chart(version=1), "VERSION_TYPE", "/version"), ([], "OBJECT_TYPE", ""), (chart(info=3), "OBJECT_TYPE", "/info"),
        (chart(info={"title": 1}), "INFO_FIELD_TYPE", "/info/title"), (chart(info={"back_image": 1}), "RESOURCE_PATH_TYPE", "/info/back_image"), (chart(info={"title_image": None}), "TITLE_IMAGE_NULL", "/info/title_image"),
        (chart(info={"title_image": "t.png"}), "TITLE_IMAGE_SPEC_DISCREPANCY", "/info/title_image"), (chart(sound_channels={}), "ARRAY_TYPE", "/sound_channels"), (chart(sound_channels=[{"notes": []}]), "MISSING_FIELD", "/sound_channels/0/name"),
        (chart(sound_channels=[{"name": "a", "notes": [NOTE | {"x": -1}]}]), "LANE_UNSUPPORTED", "/sound_channels/0/notes/0"), (chart(sound_channels=[{"name": "a", "notes": [NOTE | {"c": 0}]}]), "CONTINUATION_TYPE", "/sound_channels/0/notes/0"),
        (chart(sound_channels=[{"name": "a", "notes": [NOTE | {"y": True}]}]), "UNSIGNED_INTEGER_TYPE", "/sound_channels/0/notes/0/y"), (chart(sound_channels=[{"name": "a", "notes": [NOTE | {"l": 2**32}]}]), "UNSIGNED_INTEGER_TYPE", "/sound_channels/0/notes/0/l"),
        (chart(**{"a/b~": 1}), "UNSUPPORTED_SYNTAX", "/a~1b~0"), (chart(lines=[{"z": 0}]), "UNSUPPORTED_SYNTAX", "/lines/0/z"), (chart(bga={"bga_header": [{"id": -1, "name": "m"}]}), "UNSIGNED_INTEGER_TYPE", "/bga/bga_header/0/id"),
    ],
)
def test_json_diagnostics(value, code, pointer):
    r = parse(json.dumps(value), "bmson")
    assert (code, pointer) in {(d["code"], d["pointer"]) for d in r["diagnostics"]} and r["coverage"] == "INCOMPLETE"


def test_json_repeats_and_limits(spark):
    assert {"DUPLICATE_JSON_PROPERTY", "BMSON_VERSION_UNSUPPORTED"} <= codes(parse('{"version":"1.0.0","version":"1.0.0","sound_channels":[]}', "bmson"))
    r = parse('{"version":"1.0.0","sound_channels":[],"bga":{"bga_header":[{"id":1,"id":2,"name":"m"}]}}', "bmson")
    assert "AMBIGUOUS_BGA_HEADER_ID" in codes(r) and (r["declarations"][0]["logical_id"], r["declarations"][0]["state"]) == (None, "UNKNOWN")
    for bad in ("{", '{"version":NaN}', "[" * 65 + "]" * 65, "[" * 100_000):
        assert codes(parse(bad, "bmson")) == {"INVALID_OR_DEPTH_LIMIT_JSON"}
    assert codes(parse("[" * 64 + "]" * 64, "bmson")) == {"OBJECT_TYPE"}
    files = spark.createDataFrame([("x.bmson", bytearray(json.dumps(chart(info={"back_image": "\ud800"})).encode())), ("y.bmson", bytearray(json.dumps(chart()).encode()))], "path string, content binary")
    rows = {r.path: r for r in extract.extracted(files).collect()}
    assert rows["x.bmson"].declarations[0].written_path == "\ufffd" and rows["y.bmson"].usages[3].pulse == 240


def test_extracted_rows(spark):
    files = spark.createDataFrame([("a/x.bms", bytearray(b"#WAV01 a.wav\n#00111:01\n#00111:02")), ("b.txt", None)], "path string, content binary")
    rows = {r.path: r for r in extract.extracted(files).collect()}
    assert rows["a/x.bms"].format == "BMS" and len(rows["a/x.bms"].usages) == 2 and rows["b.txt"].coverage == "INCOMPLETE"
    assert {(r.usage, r.declaration) for r in extract.bound_usages(extract.extracted(files)).collect()} == {(0, 0), (1, None)}


@pytest.mark.parametrize(
    "authored,state,policy",
    [
        ("KICK.WAV", "OBSERVED_PATH_MATCH", "WINDOWS_ORDINAL_IGNORE_CASE"), ("./kick.wav", "OBSERVED_PATH_MATCH", "LEXICAL_ORDINAL"), ("sub/../kick.wav", "OBSERVED_PATH_MATCH", "LEXICAL_ORDINAL"),
        ("../kick.wav", "OUT_OF_SCOPE", "LEXICAL_RELATIVE_V1"), ("C:\\kick.wav", "OUT_OF_SCOPE", "NO_ABSOLUTE_OR_DEVICE_LOOKUP"), ("\\\\server\\share\\k", "OUT_OF_SCOPE", "NO_ABSOLUTE_OR_DEVICE_LOOKUP"),
        *((x, "UNSUPPORTED_RESOLUTION", "NO_AMBIGUOUS_WIN32_REWRITE") for x in ("kick.wav:stream", "CON.wav", "kick.wav.", "kick.wav ", '"kick.wav"', "KICK~1.WAV", "COM¹.wav")),
        ("kick.ogg", "UNSUPPORTED_RESOLUTION", "ALTERNATE_EXTENSION_UNPROVEN"), ("kick", "UNSUPPORTED_RESOLUTION", "ALTERNATE_EXTENSION_UNPROVEN"), ("", "UNKNOWN", "NONE"), (None, "UNSUPPORTED_RESOLUTION", "NONE"), ("other.wav", "NO_OBSERVED_MATCH", "LEXICAL_RELATIVE_V1"),
    ],
)
def test_resolution(spark, authored, state, policy):
    refs = spark.createDataFrame([(1, "", authored)], "ref int, base string, authored string")
    (r,) = resolve.resolved(refs, spark.createDataFrame([("kick.wav",)], "path string")).collect()
    assert (r.state, r.policy) == (state, policy) and len(r.candidates) == (state == "OBSERVED_PATH_MATCH" or policy == "ALTERNATE_EXTENSION_UNPROVEN")


def test_ambiguous_and_limited_matches(spark):
    refs = spark.createDataFrame([(1, "d", "k.wav")], "ref int, base string, authored string")
    inventory = spark.createDataFrame([("d/k.wav",), ("d/K.wav",), ("d/K.WAV",)], "path string")
    r = resolve.resolved(refs, inventory).first()
    assert r.state == "AMBIGUOUS_PATH_MATCH" and len(r.candidates) == 3
    r = resolve.resolved(refs, inventory, max_candidates=2).first()
    assert r.state == "UNKNOWN" and len(r.candidates) == 2


PLAY = "#00111:01"


def terms_of(*lines, ext="bms"):
    """kind, id and terms (None where they can't be told) of each fact of a chart."""
    chart = extract.parse_chart("\n".join(lines).encode() if ext == "bms" else lines[0].encode(), ext)
    return [(x["kind"], x["id"], x["terms"] if x["known"] else None) for x in resolve.chart_facts(chart) if x["kind"] != "CHART"]


def test_unsupported_facts_have_no_region():
    assert {t is None for _, _, t in terms_of("#BASE 62", "#WAV01 a.wav", PLAY)} == {True}
    text = json.dumps(chart(info={"title_image": "t.png", "back_image": "b.png"}))
    title = parse(text, "bmson")
    named = {("DECLARATION", x["id"]): x["logical_id"] for x in title["declarations"]} | {("USAGE", x["id"]): x["logical_id"] for x in title["usages"]}
    assert all((t is None) == (named[kind, i] == "title_image") for kind, i, t in terms_of(text, ext="bmson")) and "title_image" in named.values()


def test_terms_of_branches():
    got = terms_of("#RANDOM 3", "#IF 1", "#WAV01 a", "#ELSEIF 2", "#WAV01 b", "#ELSE", "#WAV01 c", "#ENDIF", "#ENDRANDOM", PLAY)
    own = [(0, 3, 1, []), (0, 3, 2, [1]), (0, 3, None, [1, 2])]
    assert [[tuple(t.values()) for t in ts] for _, _, ts in got] == [[x] for x in own] + [[]]


def test_coverage_of_files(spark):
    text = "\n".join(["#WAV01 a.wav", PLAY, "#00112:02"])
    files = spark.createDataFrame([("d/x.bms", bytearray(text.encode())), ("d/y.bms", None)], "path string, content binary")
    direct, parsed = (sorted(map(tuple, resolve.usage_coverage(x).collect()), key=str) for x in (files, extract.extracted(files)))
    assert direct == parsed and [r[4] for r in direct] == [COVERED, UNCLEAR]


def test_names_and_json(spark):
    assert P.canonical_windows_path("c:/a/./b/../c") == ("C:\\a\\c", None)
    assert [P.canonical_windows_path(x)[1] for x in ("\\\\?\\C:\\a", "a/b", "C:\\..", "C:\\a?", "C:\\a.", "C:\\nul.txt")] == ["DEVICE_PATH", "NOT_ABSOLUTE", "ESCAPES_ROOT", "INVALID_CHARACTER", "TRAILING_DOT_OR_SPACE", "RESERVED_NAME"]
    assert [P.duplicate_keys(x) for x in ('{"a":1,"a":2}', '{"a":{"b":1}}', "{")] == ["a", "", None]
    df = spark.createDataFrame([("é",), (None,)], "s string").select(P.fold_key("s").alias("k"))
    assert [r.k for r in df.collect()] == ["É", None]


def test_bounded_proof(spark):
    text = b"#WAV01 k.wav\n#00111:01\n"
    twice = b"#RANDOM 2\n#IF 1\n#WAV01 k.wav\n#ENDIF\n#IF 2\n#00111:01\n#ENDIF\n#ENDRANDOM\n"
    files = spark.createDataFrame([(f"{x}/c.bms", bytearray(twice if x == "never" else text)) for x in ("ok", "gone", "case", "ogg", "two", "never")] + [("none/c.bms", bytearray(b"#TITLE t\n"))], "path string, content binary")
    inventory = spark.createDataFrame([(x,) for x in ("ok/k.wav", "never/k.wav", "case/K.WAV", "ogg/k.ogg", "two/k.wav", "two/K.wav")], "path string")
    got = {r.path.split("/")[0]: r for r in resolve.bounded_proof(extract.extracted(files), inventory).collect()}
    assert {k for k, r in got.items() if r.proof == resolve.PROVEN} == {"ok"} and got["ok"].blockers == [] and (got["ok"].satisfiable, got["ok"].declared, got["ok"].related, got["ok"].observed, got["ok"].ordinal) == (1, 1, 1, 1, 1)
    assert {k: (r.evidence[0].state, r.physical) for k, r in got.items() if r.evidence} == {
        "ok": ("ORDINAL_EXACT_OBSERVED_MATCH", "COMPLETE_ORDINAL_OBSERVED_BINDINGS"), "gone": ("NO_OBSERVED_MATCH", "INCOMPLETE_OR_NO_OBSERVED_BINDINGS"), "case": ("WINDOWS_QUALIFIED_OBSERVED_MATCH", "QUALIFIED_WINDOWS_OBSERVED_BINDINGS"),
        "ogg": ("ALTERNATE_EXTENSION_PROPOSALS_ONLY", "ALTERNATE_EXTENSION_PROPOSALS_ONLY_OR_MIXED"), "two": ("AMBIGUOUS_OBSERVED_MATCH", "AMBIGUOUS_OBSERVED_BINDINGS"), "never": ("ORDINAL_EXACT_OBSERVED_MATCH", "ORDINAL_PATHS_WITHOUT_ADMITTED_USAGE_BINDING"),
    }
    assert got["none"].physical == "NO_PHYSICAL_RESOURCE_DECLARATIONS_IN_SCOPE" and "NO_PHYSICAL_RESOURCE_BINDINGS_IN_SCOPE" in got["none"].blockers and "ORDINAL_EXACT_PHYSICAL_BINDING_COVERAGE_NOT_PROVEN" in got["case"].blockers


def test_stage_outcomes(spark):
    entries = spark.createDataFrame([(1, 1, "DIRECTORY"), (1, 2, "REGULAR_FILE"), (2, 3, "REGULAR_FILE")], "root int, entry int, kind string")
    roots, reads, verified = spark.createDataFrame([(1,), (2,), (3,)], "root int"), spark.createDataFrame([(2, "SUCCESS"), (3, "ERROR")], "entry int, status string"), spark.createDataFrame([(1,), (2,)], "root int")
    run = lambda stage, state: {tuple(r) for r in compare.stage_outcomes(stage, roots, entries, reads, verified, state).collect()}
    assert run("CONTENT", "INCOMPLETE") == {(1, "COMPLETE", 2, 1, 1), (2, "INCOMPLETE", 1, 1, 0), (3, "INCOMPLETE", 0, 0, 0)}
    assert run("PREFLIGHT", "INCOMPLETE") == {(1, "COMPLETE", 2, 1, 1), (2, "COMPLETE", 1, 1, 0), (3, "INCOMPLETE", 0, 0, 0)}
    assert {x[1] for x in run("CONTENT", "STALE")} == {"STALE"}
