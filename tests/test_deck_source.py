"""Decks through the data source, batch and stream; text files written one a deck."""

import pytest
from pyspark.sql import functions as F
from test_audit import deck, said

from conforma.operators import report
from conforma.sources import deck_source as D
from conforma.sources import pptx, scripts


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("decks")
    (path / "sub").mkdir()
    for i in range(5):
        raw = deck([said("Titulo", f"Pagina {i}", "title") + said("Corpo", "Texto" * i, "body") for _ in range(i + 1)])
        (path / ("sub" if i % 2 else ".") / f"d{i}.pptx").write_bytes(raw)
    (path / "broken.pptx").write_bytes(b"no archive")
    (path / "_hidden.pptx").write_bytes(b"no deck")
    (path / "other.txt").write_text("no deck")
    return path


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("kind", ["deck", "shape", "run", "style", "error"])
def test_same_tables_as_the_files_reader(spark, folder, tmp_path, kind):
    spark.dataSource.register(D.DeckSource)
    want = pptx.read_decks(spark, str(folder / "[!_]*.pptx"), str(tmp_path / "rows"))[kind]
    want = want.unionByName(pptx.read_decks(spark, str(folder / "sub"), str(tmp_path / "more"))[kind])
    got = spark.read.format("conforma_deck").option("kind", kind).option("partitionBytes", 9000).load(str(folder))
    assert got.schema == want.schema
    assert got.rdd.getNumPartitions() > 1
    assert rows(got) == rows(want) and got.count() > 0


def test_partitions_by_size():
    class File:
        def __init__(self, path, size):
            self.path, self.size = path, size

    made = D.planned([File("a", 70), File("b", 50), File("c", 40), File("d", 10), File("e", 500), File("f", 0)], 100)
    assert [p.paths for p in made] == [["e"], ["a", "d", "f"], ["b", "c"]]
    assert sorted(x for p in D.planned([File(f"f{i:04}", 60) for i in range(300)], 100) for x in p.paths) == [f"f{i:04}" for i in range(300)]


def test_unknown_kind(spark, folder):
    spark.dataSource.register(D.DeckSource)
    with pytest.raises(Exception, match="kind must be one of"):
        spark.read.format("conforma_deck").option("kind", "nothing").load(str(folder)).schema


def test_stream_reads_each_deck_once(spark, folder, tmp_path):
    spark.dataSource.register(D.DeckSource)
    drop = tmp_path / "drop"
    drop.mkdir()

    def run():
        read = spark.readStream.format("conforma_deck").option("kind", "slide").load(str(drop))
        q = read.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "out"))

    for i in (0, 2):
        (drop / f"d{i}.pptx").write_bytes((folder / f"d{i}.pptx").read_bytes())
    assert run().count() == 1 + 3
    (drop / "d4.pptx").write_bytes((folder / "d4.pptx").read_bytes())
    want = spark.read.format("conforma_deck").option("kind", "slide").load(str(drop))
    assert rows(run()) == rows(want)


ODD = ["plain", "", "a: b # c", '"quoted" \\ back', "yes", "- list", "tab\tnew\nline\r", "nul-ish \x01\x1f", "\x85  ﻿", "ção 😀", "[FALTA: x]", "  ends  ", "{a}", "&x *y !z %"]


def test_yaml_scripts_read_back_equal(spark, tmp_path):
    spark.dataSource.register(D.TextFiles)
    head = "deck_id string, titulo string, autor string, idioma string"
    headers = spark.createDataFrame([("a", ODD[2], None, "pt-BR"), ("b", ODD[8], "Ana: x", None)], head)
    kinds = "deck_id string, slide_no long, type string, title string, content array<string>, notes string, key_message string, number string"
    given = [("a", i + 1, "conteudo", t, ODD[: i + 1], t, None, None) for i, t in enumerate(ODD)]
    given += [("b", 1, "capa", "so um", [], None, "chave", "7"), ("b", 2, "destaque", "dois", None, None, None, "-1")]
    slides = spark.createDataFrame(given, kinds)
    notices = spark.createDataFrame([("a", "um\naviso"), ("a", "um\naviso")], "deck_id string, text string")
    lines = scripts.yaml_lines(headers, slides, notices).withColumn("file", F.concat("deck_id", F.lit(".yaml")))
    D.by_file(lines, "slide_no", "place").write.format("conforma_files").mode("append").save(str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.yaml", "b.yaml"]
    assert (tmp_path / "out" / "a.yaml").read_text().startswith("# um aviso\napresentacao:\n")
    got_headers, got_slides, errors = scripts.read_yaml_scripts(spark, str(tmp_path / "out"))
    assert errors.count() == 0
    name = F.regexp_extract("deck_id", r"(\w+)\.yaml$", 1).alias("deck_id")
    columns = slides.columns[1:]
    assert rows(got_slides.select(name, *columns)) == rows(slides)
    assert rows(got_headers.select(name, *headers.columns[1:])) == rows(headers)


def test_reports_one_file_a_deck(spark, tmp_path):
    spark.dataSource.register(D.TextFiles)
    data = [(f"d{i % 3}", "A01", "E", "fail", i, 0, None, None, f"x|{i}") for i in range(30)]
    found = spark.createDataFrame(data, "deck_id string, rule string, severity string, verdict string, slide_no long, shape_ord int, para_ord int, value double, detail string")
    lines = report.markdown_lines(found).withColumn("file", F.concat(F.lit("by/"), "deck_id", F.lit(".md")))
    for _ in range(2):  # the second run replaces the first one's files
        D.by_file(lines, "place").write.format("conforma_files").mode("overwrite").save(str(tmp_path))
    want = {r.deck_id: r.markdown for r in report.as_markdown(found).collect()}
    got = {p.stem: p.read_text().rstrip("\n") for p in (tmp_path / "by").iterdir()}
    assert got == want and not list(tmp_path.glob("_temporary*"))


def test_a_repeated_attempt_leaves_one_file(tmp_path):
    writer = D.FilesWriter(str(tmp_path), overwrite=False)
    first = [{"file": "a.txt", "line": "lost"}]

    def dies():
        yield from first
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        writer.write(dies())
    message = writer.write([{"file": "a.txt", "line": "kept"}, {"file": "b.txt", "line": "1"}, {"file": "b.txt", "line": "2"}])
    writer.commit([message, None])
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {"a.txt": "kept\n", "b.txt": "1\n2\n"}
    again = D.FilesWriter(str(tmp_path), overwrite=True)
    lost = again.write([{"file": "a.txt", "line": "never seen"}])
    again.abort([lost])
    assert (tmp_path / "a.txt").read_text() == "kept\n" and len(list(tmp_path.iterdir())) == 2
    split = D.FilesWriter(str(tmp_path), overwrite=False)
    with pytest.raises(ValueError, match="by_file"):
        split.commit([split.write([{"file": "c.txt", "line": "x"}]), split.write([{"file": "c.txt", "line": "y"}])])
    assert not (tmp_path / "c.txt").exists()
