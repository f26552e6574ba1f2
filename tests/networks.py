"""Small networks with known pairs. Each: grid size, nodes (id: row, column), edges, and the cells' flow."""

Y = {
    "shape": (10, 10),
    "nodes": {0: (0, 2), 1: (0, 7), 2: (1, 3), 3: (1, 6), 4: (2, 4), 5: (3, 4), 6: (4, 4)},
    "edges": [(0, 2), (2, 4), (1, 3), (3, 4), (4, 5), (5, 6)],
}
COMPLEX = {
    "shape": (12, 12),
    "nodes": {0: (0, 1), 1: (0, 3), 2: (0, 8), 3: (0, 10), 4: (2, 2), 5: (2, 9), 6: (6, 5), 7: (8, 5)},
    "edges": [(0, 4), (1, 4), (2, 5), (3, 5), (4, 6), (5, 6), (6, 7)],
}
TOUCHING = {
    "shape": (6, 6),
    "nodes": {0: (0, 1), 1: (0, 4), 2: (2, 2), 3: (3, 2), 4: (4, 2)},
    "edges": [(0, 2), (1, 2), (2, 3), (3, 4)],
    "flow": [((0, 0), (0, 1)), ((1, 0), (0, 1)), ((1, 1), (0, 1)), ((1, 2), (0, 1)), ((0, 5), (0, 4)), ((1, 3), (0, 4)), ((1, 4), (0, 4)), ((1, 5), (0, 4)),
             ((0, 1), (2, 2)), ((0, 4), (2, 2)), ((2, 2), (3, 2)), ((3, 2), (4, 2))],
}


def build(spark, which, by_cell=False):
    """(Network, flow, ncols). by_cell: nodes are named by their cells, as areas of heads need it."""
    from thalweg.operators.network import network

    ncols = which["shape"][1]
    name = {k: r * ncols + c if by_cell else k for k, (r, c) in which["nodes"].items()}
    nodes = spark.createDataFrame([("b", name[k], r, c) for k, (r, c) in which["nodes"].items()], "basin string, node_id long, r long, c long")
    edges = spark.createDataFrame([("b", name.get(u, u), name.get(v, v)) for u, v in which["edges"]], "basin string, u long, v long")
    flow = which.get("flow") or [(which["nodes"][u], which["nodes"].get(v, (0, 0))) for u, v in which["edges"]]
    cells = spark.createDataFrame([("b", a * ncols + b, x * ncols + y) for (a, b), (x, y) in flow], "basin string, cell_id long, down_id long")
    return network(nodes, edges), cells, ncols
