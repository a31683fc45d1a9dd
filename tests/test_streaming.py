"""Cards from a stream of files."""

from lectern.streaming import cards as stream

from .test_cards import image, text_chunk, wrapped


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.png").write_bytes(image(text_chunk("chara", wrapped(name=f"N{i}"))))
    (folder / "bad.png").write_bytes(b"x")
    (folder / "other.txt").write_bytes(b"x")
    counts = stream.spec_counts(stream.stream_cards(spark, str(folder)))
    query = counts.writeStream.outputMode("complete").format("memory").queryName("specs").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r["spec_version"]: r["cards"] for r in spark.table("specs").collect()} == {"2.0": 3, "failure": 1}
