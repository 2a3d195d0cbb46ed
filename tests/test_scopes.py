"""References that their own words single out."""

from delvegraph.operators import resolve as R


def test_receivers_and_qualifiers_narrow_a_name(spark):
    tree = spark.createDataFrame([("Dog", "Animal"), ("Cat", "Animal"), ("Puppy", "Dog")], "derived string, base string")
    cones = R.class_cones(tree)
    assert {r.member for r in cones.filter("type = 'Dog'").collect()} == {"Dog", "Animal", "Puppy"}
    sym = [(1, "speak", "Animal"), (2, "speak", "Robot"), (3, "speak", "zoo::Cat"), (4, "run", "Robot"), (5, "only", "Robot")]
    symbols = spark.createDataFrame([(i, n, s, "a.cpp", "", "cpp", 0, False) for i, n, s in sym], "sym_id int, name string, scope string, file string, dir string, lang string, params int, arity_exact boolean")
    hints = {1: (None, None, "Dog"), 2: ("Cat", None, None), 3: (None, "Robot", None), 4: (None, None, "Fish"), 5: (None, None, None)}
    refs = spark.createDataFrame([(k, 90 + k, "b.cpp", "x", "cpp", "speak", 0, *h) for k, h in hints.items()] + [(6, 96, "b.cpp", "x", "cpp", "only", 0, None, None, None)], "ref_id int, from_sym int, file string, dir string, lang string, callee string, arg_count int, qualifier string, self_scope string, recv_type string")
    got = {(r.ref_id, r.dst, r.k) for r in R.resolve_scoped(refs, symbols, cones).collect()}
    # a Dog's speak is the Animal's; Cat names zoo::Cat; an unknown type or no hint leaves three far definitions, so none
    assert got == {(1, 1, 1), (2, 3, 1), (3, 2, 1), (6, 5, 1)}
