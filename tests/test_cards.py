"""Sources, parsing, cleaning, detectors, aggregates, selection and export on small hand-made cards."""

import base64
import json
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from lectern.functions import patterns as P
from lectern.functions import text as X
from lectern.operators import aggregate as A
from lectern.operators import features as D
from lectern.operators import render as K
from lectern.operators import select as R
from lectern.operators import tokens as T
from lectern.plans import api, cli
from lectern.plans import guidance as G
from lectern.sources import cards as S
from lectern.sources import png


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def image(*chunks: bytes) -> bytes:
    return png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 2, 0, 0, 0)) + b"".join(chunks) + chunk(b"IEND", b"")


def text_chunk(keyword: str, payload: object, raw: bool = False) -> bytes:
    text = payload if isinstance(payload, str) else json.dumps(payload)
    return chunk(b"tEXt", keyword.encode() + b"\0" + (text.encode() if raw else base64.b64encode(text.encode())))


def wrapped(version: str = "2.0", **data: object) -> dict:
    return {"spec": f"chara_card_v{version[0]}", "spec_version": version, "data": data}


def card(ord_: int, **fields: object) -> dict:
    return {"ord": ord_, **fields}


def frame(spark, rows: list[dict]):
    texts = [json.dumps(r) for r in rows]
    return S.from_json(spark.createDataFrame([(t,) for t in texts], "json string"))


def test_chunk_kinds():
    data = image(
        chunk(b"tEXt", b"a\0one"),
        chunk(b"zTXt", b"b\0\0" + zlib.compress(b"two")),
        chunk(b"iTXt", b"c\0\0\0en\0t\0" + "drei é".encode()),
        chunk(b"iTXt", b"d\0\1\0\0\0" + zlib.compress("vier".encode())),
        chunk(b"tEXt", b"no keyword end"),
        chunk(b"zTXt", b"e\0\1xx"),
        chunk(b"pHYs", b"ignored"),
    )
    assert [(k, t) for _, k, t, _ in png.text_chunks(data)] == [("a", "one"), ("b", "two"), ("c", "drei é"), ("d", "vier")]
    assert [k for _, k, *_ in png.text_chunks(data[:60])] == ["a"]
    with pytest.raises(ValueError, match="bad signature"):
        png.text_chunks(b"GIF89a")


def test_extraction(spark):
    both = image(text_chunk("chara", wrapped(name="Two", description="old")), text_chunk("ccv3", wrapped("3.0", name="Three", first_mes="", greeting="Hi", tags="solo", creatorcomment="c")))
    files = [
        ("v1.png", image(text_chunk("chara", {"name": 7, "description": "a\r\n\r\n\r\n\r\nb <b>x</b>", "tags": ["t", "", None, 3]}))),
        ("both.png", both),
        ("raw.png", image(text_chunk("chara", {"name": "Raw"}, raw=True))),
        ("last.png", image(text_chunk("chara", wrapped(name="First")), text_chunk("chara", wrapped(name="Last", character_book={"entries": [{"keys": ["k"], "content": "x  y"}, 3, {"key": "s"}]})))),
        ("fallback.png", image(text_chunk("ccv3", "{broken", raw=True), text_chunk("chara", wrapped(name="Kept", personality="p")))),
        ("none.png", image(chunk(b"tEXt", b"Software\0x"))),
        ("empty.png", image(text_chunk("chara", wrapped(scenario="only this")))),
        ("bad.png", b"not a png"),
    ]
    cards, failures = S.extract_bytes(spark, files)
    found = {r["source_file"]: r for r in cards.collect()}
    assert found["v1.png"]["name"] == "7" and found["v1.png"]["spec_version"] == "1.0" and found["v1.png"]["tags"] == ["t", "3"]
    assert found["v1.png"]["description"] == "a\n\nb x" and found["v1.png"]["bloat_chars_removed"] == 9
    three = found["both.png"]
    assert (three["name"], three["source_keyword"], three["first_mes"], three["tags"], three["creator_notes"]) == ("Three", "ccv3", "Hi", ["solo"], "c")
    assert found["raw.png"]["name"] == "Raw" and found["fallback.png"]["name"] == "Kept"
    book = found["last.png"]["lorebook_entries"]
    assert found["last.png"]["name"] == "Last" and [(list(e["keys"]), e["content"]) for e in book] == [(["k"], "x y"), (["s"], "")]
    reasons = {r["path"]: r["reason"] for r in failures.collect()}
    assert reasons == {"none.png": S.NO_CARD, "empty.png": S.NO_CARD, "bad.png": png.NOT_A_PNG}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", ""), ("a\r\nb\rc", "a\nb\nc"), ("x data:image/png;base64," + "A" * 24 + " y", "x y"), ("a<!-- b\nc -->d", "ad"), ("![p](http://x)z", "z"), ("<:smile:12>q<a:w:3>", "q"),
        ("<b>bold</b> <START> <FIRST>", "bold <START> <FIRST>"), ("a\n--------\nb", "a\n\nb"), ("★★★★★", ""), ("ééééé", "ééééé"), ("aaaaaaaa", "aaaaaaaa"), ("**bold text**", "**bold text**"),
        ("a   b\t\tc", "a b c"), ("a\n\n\n\n\nb", "a\n\nb"), ("  x  ", "x"), ("\x1cx\x1f", "x"), ("<imgx>keep", "<imgx>keep"),
    ],
)
def test_cleaning(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(X.cleaned(F.col("t")).alias("c"), X.removed(F.col("t"), X.cleaned(F.col("t"))).alias("n")).first()
    assert row["c"] == want
    assert row["n"] == max(0, len(re.sub("\r\n?", "\n", text)) - len(want))


def test_text_functions(spark):
    rows = spark.createDataFrame([("",), ("ab",), ("a b c d",), ("x" * 10,), ("one two  ",)], "t string")
    got = [tuple(r) for r in rows.select(X.token_heuristic(F.col("t")), X.truncated(F.col("t"), F.lit(4)), X.truncated(F.col("t"), F.lit(None).cast("int"))).collect()]
    assert got == [(0, "", ""), (1, "ab", "ab"), (5, "a b …[truncated]", "a b c d"), (2, "xxxx …[truncated]", "x" * 10), (3, "one …[truncated]", "one two  ")]
    assert [T.heuristic(t) for t in ("", "ab", "a b c d", "x" * 10, "one two  ")] == [0, 1, 5, 2, 3]


DOSSIER = "<Ann>\n>Appearance\n+ tall\n>Personality\n+ warm\n>Backstory\n+ far\n</Ann>"
BARE = "<Ann>\nAppearance\ntall.\nPersonality\nwarm.\n</Ann>"


def test_detectors(spark):
    rows = [
        card(0, name="Ann", description=DOSSIER, first_mes='*She waves.* "Hello there"', mes_example="<START>\n{{user}}: hi\n{{char}}: `what now`", scenario="<instructions>x</instructions>"),
        card(1, name="Ann & Bo", description="<Ann>\nx\n</Ann>\n<Bo> y </Bo> <Cy>", first_mes="11:12 PM | August 6 | Rain\n\nText."),
        card(2, name="The Hale Family", description="Alone\nstyle: red\nnot a header."),
        card(3, name="Sandy", description=BARE + "\n<NPCs></NPCs>", first_mes='He says "yes yes" *'),
    ]
    f = {r["ord"]: r for r in D.features(frame(spark, rows)).collect()}
    assert f[0]["section_names"] == ["Appearance", "Personality", "Backstory"] and f[0]["section_style"] == "marked_bulleted" and f[0]["turns"] == 2
    assert all(f[0][k] for k in ("opens_action", "ends_speech", "asterisk", "quoted", "backtick", "start_marker", "instructions", "char_placeholder", "user_placeholder"))
    assert sorted(f[1]["named_blocks"]) == ["ann", "bo"] and f[1]["multi_character"] and f[1]["status_line"] and f[1]["paragraphs"] == 2
    assert f[2]["section_names"] == [] and f[2]["multi_character"] and f[2]["section_style"] is None
    assert f[3]["section_style"] == "bare_plain" and f[3]["npc_block"] and f[3]["multi_character"] and f[3]["ends_speech"]


def test_headers_need_unix_lines(spark):
    row = D.features(frame(spark, [card(0, name="x", description="one two words three")])).first()
    assert row["section_names"] == []


def corpus_of(spark, dossiers: int, plain: int):
    rows = [card(i, name=f"D{i:03d}", description=DOSSIER, first_mes="*Hi.* x", tags=["A", " b "]) for i in range(dossiers)]
    rows += [card(dossiers + i, name=f"P{i:03d}", description="Just prose here." * 3, first_mes="Hello.") for i in range(plain)]
    return frame(spark, rows)


def test_summary_and_names(spark):
    f = D.features(corpus_of(spark, 3, 7)).cache()
    s = A.conv_summary(f).first()
    assert (s["total_cards"], s["section_header_cards"], s["plus_bullet_cards"], s["median_description_chars"]) == (10, 3, 3, 48)
    assert [(r["name"], r["cards"]) for r in A.section_names(f).orderBy("place").collect()] == [("Appearance", 3), ("Personality", 3), ("Backstory", 3)]
    assert [(r["tag"], r["cards"]) for r in A.top_tags(f).collect()] == [("a", 3), ("b", 3)]
    assert A.dominant_style(f).first()["section_style"] == "marked_bulleted"


def test_agreement_and_ranks(spark):
    scored = R.scored(D.features(corpus_of(spark, 25, 25)))
    got = R.structure_consistency(scored).first()
    assert (got["cards"], got["structured"], got["agreeing_prefix"], got["stable"]) == (50, 25, 31, True)
    ranked = R.rank_cards(scored).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 51)) and [r["name"] for r in ranked[:2]] == ["D000", "D001"]
    assert [r["name"] for r in R.exemplars(scored).collect()] == ["D000", "D001", "D002"]
    assert R.select_best(scored, 0).count() == 50 and R.select_best(scored, 7).count() == 7


def test_pins(spark):
    ranked = spark.createDataFrame([(i, f"f{i}", i + 1) for i in range(6)], "ord long, source_file string, rank long")
    pins = spark.createDataFrame([("f4",), ("f2",), ("",)], "source_file string")
    got = R.apply_pins(ranked, pins).orderBy("place").collect()
    assert [r["ord"] for r in got] == [2, 4, 0, 1, 3, 5]


def test_options():
    assert K.extra_fields(None) == {"tags"} and K.extra_fields("") == frozenset() and K.extra_fields("none") == frozenset()
    assert K.extra_fields("lorebook, nonsense") == {"lorebook"} and K.extra_fields("all") == frozenset(K.EXTRA_FIELDS)
    assert K.field_caps(["first_mes=1200", "x=1", "scenario=0", "personality=z"]) == ({"first_mes": 1200}, ["x=1", "scenario=0", "personality=z"])


@pytest.mark.parametrize("form", api.FORMATS)
def test_export(spark, form):
    rows = [card(i, name=f"N{i:02d}", description="d" * 3000, first_mes="f" * 100, source_file=f"a/{i}.png", spec_version="2.0") for i in range(12)]
    text = api.export(frame(spark, rows), api.Options(form, caps=["first_mes=20"]))
    assert text.count("d" * 3000) == 10 and text.count(" …[truncated]") == 2 + 12
    if form == "json":
        got = json.loads(text)
        assert got["count"] == 12 and len(got["cards"]) == 12 and got["cards"][0]["description"] == "d" * 3000 and got["tokens"] > 0
    else:
        assert re.findall(r"(?:## Card|=== CARD) (\d+)/12", text) == [str(i) for i in range(1, 13)]
        assert text.count("WRITING THE NEW CHARACTER") == 2


def test_empty_corpus(spark):
    none = frame(spark, [card(0, name="x")]).where("ord < 0")
    assert "(0 cards)" in api.export(none)
    assert R.structure_consistency(R.scored(D.features(none))).first()["cards"] == 0
    assert A.section_names(D.features(none)).count() == 0


def test_estimate(spark):
    got = api.estimate(corpus_of(spark, 3, 2))
    assert got["total_tokens"] > 0 and got["cards"].count() == 5 and got["consistency"]["structured"] == 3 and got["context_warning"] == []


def test_guidance_rules(spark):
    c = api.corpus(R.scored(D.features(corpus_of(spark, 8, 92))))
    s = G.style_sections(c)
    assert any("named sections" in x and "8 of 100 cards (8%)" in x for x in s["approaches"])
    assert G.description_skeleton(c).startswith("<Name>\n>Appearance\n+ ")
    assert {g["field"]: bool(g["note"]) for g in G.field_guidance(c)} == {"description": False, "personality": True, "scenario": True, "first_mes": False, "mes_example": True}
    assert G.cast_note(c) == [] and G.context_warning(10, 5) == [] and len(G.context_warning(400_000, 113)) == 3
    assert T.count_tokens("a b", "nowhere").method == T.HEURISTIC


def test_command(spark, tmp_path, capsys):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.png").write_bytes(image(text_chunk("chara", wrapped(name="A", description=DOSSIER))))
    (tmp_path / "in" / "sub" / "b.png").write_bytes(image(text_chunk("chara", {"name": "B"})))
    (tmp_path / "in" / "c.PNG").write_bytes(b"x")
    (tmp_path / "in" / "d.png").write_bytes(b"x")
    out, bad = tmp_path / "o.md", tmp_path / "bad.txt"
    assert cli.main([str(tmp_path / "in"), "-o", str(out), "--report-failures", str(bad), "--cap", "nope=1"], spark) == 0
    said = capsys.readouterr()
    assert "Scanned 3 PNG file(s)." in said.out and "Extracted 2 card(s) (v1.0: 1, v2.0: 1)." in said.out and "nope=1" in said.err
    assert "## Card 1/2: A" in out.read_text() and png.NOT_A_PNG in bad.read_text()
    (tmp_path / "void").mkdir()
    assert cli.main([str(tmp_path / "void"), "-o", str(out)], spark) == 1


def test_python_agrees_on_odd_strings(spark):
    """The JVM's patterns against Python's on strings of awkward characters."""
    import random

    rng = random.Random(3)
    signs = ["a", "B", " ", "\n", "\t", ">", "+", "*", "“", "”", '"', "é", " ", " ", "1", "-", "&", "|", "`"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(1, 40))) for _ in range(1500)]
    plain = lambda p: re.sub(r"^\(\?([a-zA-Z]+)\)", lambda m: "(?" + m[1].replace("d", "").replace("U", "") + ")", p).replace("(?)", "").replace(r"\z", r"\Z")
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for name in ("ASTERISK_ACTION", "QUOTED_SPEECH", "BACKTICK_THOUGHT", "PLUS_BULLET", "GROUP_NAME", "OPENS_WITH_ACTION", "ENDS_ON_SPEECH", "STATUS_LINE"):
        pattern = getattr(P, name)
        got = [r[0] for r in df.select(F.col("t").rlike(pattern)).collect()]
        assert got == [bool(re.search(plain(pattern), t)) for t in texts], name
    got = [list(r[0]) for r in df.select(D.header_names(F.col("t"))).collect()]
    assert got == [[m[1] for m in re.findall(plain(P.SECTION_HEADER), t)] for t in texts]


def test_two_uploads_of_one_name(spark):
    cards, failures = S.extract_bytes(spark, [("a.png", image(text_chunk("chara", {"name": "A"}))), ("a.png", image(text_chunk("chara", {"name": "B"}))), ("a.png", b"x")])
    assert sorted((r["ord"], r["name"]) for r in cards.collect()) == [(0, "A"), (1, "B")] and failures.count() == 1


def test_scan_lists_before_it_reads(spark, tmp_path):
    """Missing inputs warn, two ways to a file are one, and no exchange moves a file's bytes."""
    (tmp_path / "d").mkdir()
    for name in ("b.png", "a.png", "C.PNG"):
        (tmp_path / "d" / name).write_bytes(image(text_chunk("chara", {"name": name})))
    (tmp_path / "link").symlink_to(tmp_path / "d")
    inputs = [str(tmp_path / "d" / "b.png"), str(tmp_path / "nowhere"), str(tmp_path / "link"), f"{tmp_path}/d/../d"]
    with pytest.warns(UserWarning, match="nowhere"):
        found = png.scan(spark, inputs)
    assert [(r["ord"], r["path"].rsplit("/", 1)[1]) for r in found.orderBy("ord").collect()] == [(1, "b.png"), (2, "a.png")]
    assert png.scan(spark, [str(tmp_path / "d")], any_case=True).count() == 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    below = [line for line in plan.splitlines() if "Exchange" in line]
    assert below and "content" not in "".join(below)
    cards, failures = api.extract(spark, [str(tmp_path / "d")])
    assert [r["name"] for r in cards.orderBy("ord").collect()] == ["a.png", "b.png"] and failures.count() == 0
    assert png.scan(spark, []).count() == 0


@pytest.mark.parametrize("form", api.FORMATS)
def test_export_to_parts(spark, tmp_path, form):
    """Part files joined by name are the document, but for the token count, which is a sum over parts."""
    rows = [card(i, name=f"N{i:02d}", description="d" * 900, source_file=f"a/{i}.png", spec_version="2.0") for i in range(30)]
    o = api.Options(form)
    api.export_to(frame(spark, rows), str(tmp_path / form), o)
    parts = sorted((tmp_path / form).glob("part-*"))
    text, want = "".join(p.read_text() for p in parts), api.export(frame(spark, rows), o)
    if form == "json":
        got, whole = json.loads(text), json.loads(want)
        assert list(got) == list(whole) and {k: v for k, v in got.items() if k != "tokens"} == {k: v for k, v in whole.items() if k != "tokens"}
        assert got["response_template"]["instruction"]
    else:
        squeeze = lambda t: [x for x in re.sub(r"[\d,]+ tokens", "n tokens", t).splitlines() if x.strip("-# ")]
        assert squeeze(text) == squeeze(want)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from lectern.plans import session

    class Context:
        master = "spark://somewhere"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        session.shared_dir(Session())
    monkeypatch.setattr(Context, "getCheckpointDir", lambda self: "hdfs://x/y")
    assert session.shared_dir(Session()) == "hdfs://x/y"


def test_exact_counts_are_the_library_s(spark):
    from tokenizers import Tokenizer

    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = ["", "one", "Hello, wide world! " * 20, "é漢🎉\n\n  x"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.tokens_of(F.col("t"), path).alias("n")).collect()
    assert {r["i"]: r["n"] for r in got} == {i: len(tok.encode(t).ids) for i, t in enumerate(texts)}
    count = T.count_tokens(texts[2], path)
    assert count.exact and count.method == "byte_bpe_50k.json tokenizer" and not T.count_tokens("a b", "/nowhere.json").exact


def test_removed_cards(spark):
    cards = frame(spark, [card(i, name=f"N{i}", source_file=f"{i}.png") for i in range(5)])
    text = api.export(cards, api.Options("compact", removed=("1.png", "3.png", "9.png")))
    assert "Name: N0" in text and "Name: N1" not in text and "CARD 3/3" in text
