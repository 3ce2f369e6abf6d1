import numpy as np

from graphloom.operators import atoms

SCHEMA = "graph_id long, node_id long, coords array<double>, chain_id string, residue_name string, residue_number int, atom_type string, element_symbol string"


def ring(first, residue, number, centre, axes, missing=0):
    names = atoms.RINGS[residue]
    a, b = np.eye(3)[axes[0]], np.eye(3)[axes[1]]
    turn = [2 * np.pi * i / len(names) for i in range(len(names))]
    return [(0, first + i, (np.array(centre) + 1.4 * (np.cos(t) * a + np.sin(t) * b)).tolist(), "A", residue, number, n, n[0]) for i, (n, t) in enumerate(zip(names, turn))][missing:]


def test_rings_by_plane(spark):
    rows = ring(0, "PHE", 1, [0, 0, 0], (0, 1)) + ring(10, "TRP", 2, [0, 0, 3.8], (1, 0)) + ring(20, "HIS", 3, [5.0, 0, 0], (0, 2)) + ring(30, "TYR", 4, [0, 0, -4], (0, 1), missing=1)
    made = spark.createDataFrame(rows, SCHEMA)
    got = {r.node_id: (r.coords, r.normal) for r in atoms.rings(made).collect()}
    assert set(got) == {0, 10, 20}  # a ring that lacks an atom is none
    np.testing.assert_allclose(got[10][0], [0, 0, 3.8], atol=1e-9)
    np.testing.assert_allclose(np.abs(got[20][1]), [0, 1, 0], atol=1e-9)
    flat = atoms.pi_stacking(made).collect()
    assert [(r.u, r.v, round(r.distance, 6), round(r.angle, 3)) for r in flat] == [(0, 10, 3.8, 0.0)]
    assert {(r.u, r.v, round(r.angle, 3)) for r in atoms.t_stacking(made).collect()} == {(0, 20, 90.0), (10, 20, 90.0)}


def test_bonds_by_atom_names(spark):
    at = lambda i, x, residue, number, name, chain="A": (0, i, [float(x), 0.0, 0.0], chain, residue, number, name, name[0])
    rows = [at(0, 0, "ALA", 1, "O"), at(1, 2.9, "GLY", 5, "N"), at(2, -2.9, "PRO", 6, "N"), at(3, 3.0, "ALA", 2, "N"), at(4, 3.1, "SER", 9, "OG", "B"), at(5, 2.0, "ALA", 7, "C"), at(6, 0.5, "ALA", 1, "C"), at(7, 0.1, "ALA", 8, "CB")]
    made = spark.createDataFrame([*rows, (0, 8, None, "A", "GLY", 20, "N", "N")], SCHEMA)
    found = {(r.u, r.v) for r in atoms.hydrogen_bonds(made).collect()}
    # not proline's nitrogen, not the next residue's, not an atom without a place; a hydroxyl gives and takes
    assert found == {(0, 1), (0, 4), (1, 4), (3, 4)}
    assert {(r.u, r.v) for r in atoms.carbonyls(made).collect()} == {(0, 5)}


def test_no_atoms(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for f in (atoms.rings, atoms.pi_stacking, atoms.t_stacking, atoms.hydrogen_bonds, atoms.carbonyls):
        assert f(empty).isEmpty()
