import numpy as np

from graphloom.plans import build_job
from graphloom.sources import files

ATOM = "ATOM  {:5d} {:^4s} {:3s} {:1s}{:4d}    {:8.3f}{:8.3f}{:8.3f}{:6.2f}{:6.2f}          {:>2s}\n"


def test_codes_and_structures_to_a_store(spark, tmp_path):
    rng = np.random.default_rng(2)
    (tmp_path / "pdb").mkdir()
    for code, n in (("1abc", 8), ("2xyz", 5)):
        lines = [ATOM.format(2 * i, name, ["PHE", "TYR", "MET"][i % 3], "A", i + 1, *rng.uniform(-6, 6, 3), 1.0, 0.5, "C") for i in range(n) for name in ("N", "CA")]
        (tmp_path / "pdb" / f"{code}.pdb").write_text("".join(lines))
    (tmp_path / "codes.txt").write_text("# codes\n2xyz\n9zzz\n1ABC\n2XYZ\n")
    out = str(tmp_path / "out")
    store = build_job.run(spark, str(tmp_path / "codes.txt"), str(tmp_path / "pdb"), out)
    assert [r.graph_code for r in store.codes().collect()] == ["2XYZ", "1ABC"]  # as the list has them
    assert {r.part: r.rows for r in store.describe().collect()}["graph_nodes"] == 13
    kinds = {k for r in store.extract_edges("1abc").collect() for k in r.kinds}
    assert "delaunay" in kinds and kinds <= {"delaunay", "aromatic", "aromatic_sulphur"}
    assert [r.code for r in spark.read.json(f"{out}/errors").collect()] == ["9ZZZ"]
    assert files.csv(spark, f"{out}/results", "min_edges long, max_edges long, min_nodes long, max_nodes long, smallest string, largest string, n_graphs long, n_nodes long, n_edges long, dataset string").first().n_nodes == 13
