import pytest

from graphloom.functions import labels, units
from graphloom.sources import files, sinks
from pyspark.sql import functions as F


def test_code_list(spark, tmp_path):
    (tmp_path / "codes.txt").write_text("# comment\n1abc\n 2xYz \n\n3def")
    assert [r.code for r in files.code_list(spark, str(tmp_path / "codes.txt")).collect()] == ["1ABC", "2XYZ", "", "3DEF"]


def test_tsv_and_csv(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("# head\nd1\t1abc\tA:\ta.1.1.1\t12\tcl=1\n")
    row = files.tsv(spark, str(tmp_path / "t.tsv")).first()
    assert (row.pdb, row.sccs, row.sunid) == ("1abc", "a.1.1.1", 12)
    (tmp_path / "t.csv").write_text("Free PDB,motion_type\n1abc,hinge\n")
    assert files.csv(spark, str(tmp_path / "t.csv"), "`Free PDB` string, motion_type string").first().motion_type == "hinge"


def test_samples_and_numbers(spark, tmp_path):
    (tmp_path / "m.csv").write_text("1,1.5GiB / 15.39GiB\n2,512MiB / 15.39GiB\n3,odd\n")
    got = files.samples(spark, str(tmp_path / "m.csv")).select(units.gib(F.col("memory")).alias("g")).collect()
    assert [r.g for r in got] == [1.5, 0.5, None]
    (tmp_path / "n.txt").write_text("1.5\n\n2\n")
    assert sorted(r.value for r in files.numbers(spark, str(tmp_path / "n.txt")).collect()) == [1.5, 2.0]


def test_structures(spark, tmp_path):
    atom = "ATOM  {:5d} {:^4s} {:3s} {:1s}{:4d}    {:8.3f}{:8.3f}{:8.3f}{:6.2f}{:6.2f}          {:>2s}\n"
    lines = ["HEADER    TEST\n", atom.format(1, "N", "ALA", "A", 89, 1.0, 2.0, 3.0, 1.0, 0.37, "N"), atom.format(2, "CA", "ALA", "A", 89, -1.5, 2.0, 3.25, 1.0, 0.5, "C")]
    (tmp_path / "1bxl.pdb").write_text("".join(lines))
    atoms = files.structures(spark, str(tmp_path / "1bxl.pdb"))
    assert [(r.code, r.atom_type, r.residue_number, r.x, r.z) for r in atoms.collect()] == [("1BXL", "N", 89, 1.0, 3.0), ("1BXL", "CA", 89, -1.5, 3.25)]
    nodes = files.raw_nodes(atoms)
    assert [(r.node_label, r.coords) for r in nodes.collect()] == [("A:ALA:89", [-1.5, 2.0, 3.25])]
    assert files.raw_nodes(atoms, "atom").count() == 2


def test_models_alternates_and_insertions(spark, tmp_path):
    atom = "ATOM  {:5d} {:^4s}{:1s}{:3s} {:1s}{:4d}{:1s}   {:8.3f}{:8.3f}{:8.3f}{:6.2f}{:6.2f}          {:>2s}\n"
    rows = [(1, "CA", "A", "ALA", "H", 52, ""), (2, "CA", "B", "ALA", "H", 52, ""), (3, "CA", "", "ALA", "H", 52, "A"), (4, "CA", "", "GLY", "H", -3, "")]
    model = lambda m: f"MODEL     {m:4d}\n" + "".join(atom.format(*r, 10.0 * m + r[0], 0.0, 0.0, 1.0, 0.5, "C") for r in rows) + "ENDMDL\n"
    (tmp_path / "2abc.pdb").write_text("HEADER    TEST\n" + model(1) + model(2) + "END\n")
    (tmp_path / "3abc.pdb").write_text(atom.format(*rows[0], 1.0, 0.0, 0.0, 1.0, 0.5, "C").replace("\n", "\r\n"))
    (tmp_path / "4abc.pdb").write_text("")
    atoms = files.structures(spark, str(tmp_path))
    assert {(r.code, r.model): r["count"] for r in atoms.groupBy("code", "model").count().collect()} == {("2ABC", 1): 4, ("2ABC", 2): 4, ("3ABC", 1): 1}
    of = lambda **options: sorted((r.graph_code, r.seq, r.node_label, r.coords[0]) for r in files.raw_nodes(atoms, **options).collect())
    first = [("2ABC", 0, "H:ALA:52", 11.0), ("2ABC", 0, "H:ALA:52A", 13.0), ("2ABC", 0, "H:GLY:-3", 14.0), ("3ABC", 0, "H:ALA:52", 1.0)]
    assert of() == first
    assert of(insertions=False) == [first[0], *first[2:]]
    assert [r[3] for r in of(model=2)] == [21.0, 23.0, 24.0]
    order = spark.createDataFrame([("3ABC", 5)], "graph_code string, seq long")
    assert of(order=order) == [("3ABC", 5, "H:ALA:52", 1.0)]
    numbers = files.raw_nodes(atoms).select(*labels.parsed(F.col("node_label"))).collect()
    assert sorted(r.residue_number for r in numbers) == [-3, 52, 52, 52]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5)], "dataset string, seconds double")
    sinks.results(df, str(tmp_path / "r"))
    sinks.results(df, str(tmp_path / "r"), append=True)
    assert files.csv(spark, str(tmp_path / "r"), "dataset string, seconds double").count() == 2
    sinks.errors(spark.createDataFrame([("1ABC", "lost")], "code string, message string"), str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).first().message == "lost"
    sinks.times(df.selectExpr("seconds as value"), str(tmp_path / "s"))
    assert files.numbers(spark, str(tmp_path / "s")).first().value == pytest.approx(1.5)


def test_lines_in_order_over_many_splits(spark, tmp_path):
    """Splits of a few hundred bytes, two files; ids follow the list."""
    for name, first in (("a.txt", 0), ("b.txt", 5000)):
        (tmp_path / name).write_text("".join(f"code{(i * 7919) % 10_000:05d}\n" for i in range(first, first + 5000)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        read = files.code_list(spark, f"{tmp_path}/*.txt")
        assert read.rdd.getNumPartitions() > 50
        assert [r.code for r in read.orderBy(files.LINE).collect()] == [f"CODE{(i * 7919) % 10_000:05d}" for i in range(10_000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was[0])
        spark.conf.set("spark.sql.files.openCostInBytes", was[1])


def test_first_model_whatever_its_number(spark, tmp_path):
    atom = "ATOM  {:5d}  CA  ALA A{:4d}    {:8.3f}{:8.3f}{:8.3f}  1.00  0.50           C\n"
    (tmp_path / "1aaa.pdb").write_text("MODEL        0\n" + atom.format(1, 1, 1.0, 2.0, 3.0) + "ENDMDL\n")
    (tmp_path / "2bbb.pdb").write_text("MODEL        3\n" + atom.format(1, 1, 5.0, 2.0, 3.0) + "ENDMDL\nMODEL        2\n" + atom.format(1, 1, 6.0, 2.0, 3.0) + "ENDMDL\n")
    atoms = files.structures(spark, str(tmp_path))
    assert {(r.graph_code, r.coords[0]) for r in files.raw_nodes(atoms).collect()} == {("1AAA", 1.0), ("2BBB", 6.0)}
    assert {r.graph_code for r in files.raw_nodes(atoms, model=3).collect()} == {"2BBB"}
