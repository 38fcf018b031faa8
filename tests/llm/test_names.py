import itertools

from hypothesis import given, settings, strategies as st

from sparkloom.llm import names

SCHEMA = "entity_id long, name string, etype string, tenant_id string, cluster string, kind string"
GROUPS = [
    ("custom:entity:person", ["Winifred Gidrasteske", "Gidrasteske, Winifred", "Winnie M. Gidrmsteske", "Mx Winifred Gidrasteske", "GIDRASTESKE Winifred", "winifred.gidrasteske", "W. Gidrasteske", "Winifred Gidrasteske (Legal)", "Wínifred Gidrsateske"]),
    ("custom:entity:person", ["Robert Gidrasteske", "Bob Gidrasteske"]),
    ("custom:organization:company", ["Bokrizosi & Mokan Chemicals S.A.", "Mokan - Bokrizosi Chem. SA", "Chem. Bokrikosi+Mokan", "BOKRIZOSI AND MOKAN CHEMICALS", "Bokrizosi & MokanChemicals S. A."]),
    ("custom:organization:company", ["Bokrizosi & Mokan Trading S.A.", "Trdg Bokrizosi+Mokan"]),
    ("custom:organization:company", ["Stedetiko Textiles GmbH", "Stedetiko Text. mbH", "The Stedetiko Textile G.m.b.H."]),
    ("custom:item:product", ["Deziziki Model 138", "138 Deziziki", "DEIZZIKI mod. 138", "Deziziki-138 (spare)"]),
    ("custom:item:product", ["Deziziki Model 139", "Deziziki No. 139"]),
]


def test_resolve(spark):
    rows, want, n = [], {}, 0
    for g, (etype, spellings) in enumerate(GROUPS):
        for i, s in enumerate(spellings):
            n += 1
            rows.append((n, s, None if i == 1 else etype, "t1", "x", "y"))
            want[n] = g
    rows += [(900, "Winifred Gidrasteske", "custom:entity:person", "t2", "x", "y"), (901, None, "custom:entity:person", "t1", "x", "y"), (902, "", None, "t1", "x", "y"), (903, "...", None, "t1", "x", "y"), (904, "x", None, None, "x", "y"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.key_a, r.key_b) for r in names.linked_pairs(names.resolve(df)).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(want), 2) if want[a] == want[b]}
    assert names.linked_pairs(names.resolve(df.where("false"))).count() == 0


def test_ambiguous_initial_stays_alone(spark):
    rows = [(1, "Gerald Tristigloka", "person", "t"), (2, "Gregory Tristigloka", "person", "t"), (3, "G. Tristigloka", "person", "t"), (4, "Sam Kiduskigli", "person", "t"), (5, "Samantha Kiduskigli", "person", "t"), (6, "Samuel Kiduskigli", "person", "t")]
    df = spark.createDataFrame(rows, "entity_id long, name string, etype string, tenant_id string")
    assert names.linked_pairs(names.resolve(df)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8), st.integers(0, 3))
def test_near_against_the_full_table(a, b, most):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    assert names.near(a, b, most) == (d[len(a), len(b)] <= most)


def test_forms():
    for s in ("Vikronila, Beatrice", "Beatrice Vikronila", "VIKRONILA Beatrice", "trixie.vikronila", "Bea Vikronila (Legal)", "Dr. Trixie  Vikronila"):
        assert names.parse("person", s) == {"words": ("vikronila",), "extra": ("beatrice",)}, s
    assert names.parse("person", "V. Suplonase") == names.parse("person", "Suplonase V.")
    assert names.kind_of(None, "Deizziki mod. 139") == "product" and names.kind_of(None, "Nutifise SVCS") == "organization" and names.kind_of(None, "Jo March") == "person"


def test_long_names(spark):
    long = "Xy" * 30_000
    rows = [(1, f"Anna {long}", "person", "t"), (2, f"Anna {long[:-1]}", "person", "t"), (3, f"Anna {long[::-1]}q", "person", "t"), (4, long, "org", "t"), (5, "1" * 50_000, None, "t")]
    df = spark.createDataFrame(rows, "entity_id long, name string, etype string, tenant_id string")
    assert {tuple(r) for r in names.linked_pairs(names.resolve(df)).collect()} >= {(1, 2)}


def test_merged_profiles_are_matched_again(spark):
    rows = [
        (1, "Jonathan Zulomagu"), (2, "Jon Zulomgu"), (3, "J. Zulmgu"),  # 3 fits only the spelling that 2 brings
        (11, "Jonathan Kabdif"), (12, "Jon Kubdif"), (13, "J. Kuvdif"), (14, "Jonathan Kuvwif"),  # 12 goes to 11 and 13 to 14; then these meet by 12 and 13
        (5, "Robert Kiduskigli"), (6, "Bob Kiduskigli"), (7, "B. Kiduskigli"),
        (8, "Robert Hamovira"), (9, "Bert Hamovira"), (10, "A. Hamovira"),  # Bert is Robert here, so no Albert
    ]
    df = spark.createDataFrame([(i, n, "person", "t") for i, n in rows], "entity_id long, name string, etype string, tenant_id string")
    got = {tuple(r) for r in names.linked_pairs(names.resolve(df)).collect()}
    assert got == {*itertools.combinations((1, 2, 3), 2), *itertools.combinations((11, 12, 13, 14), 2), *itertools.combinations((5, 6, 7), 2), (8, 9)}


def test_more_rounds_than_four(spark):
    # each nickname is one edit from the last, so one more merges in each round
    word = "abcdef"
    chain = [word]
    for i, c in enumerate("uvwxyz"):
        chain.append(chain[-1][:i] + c + chain[-1][i + 1 :])
    rows = [(0, f"Jonathan {chain[0]}")] + [(i, f"{'Jon' if i % 2 else 'J.'} {w}") for i, w in enumerate(chain) if i]
    df = spark.createDataFrame([(i, n, "person", "t") for i, n in rows], "entity_id long, name string, etype string, tenant_id string")
    assert {tuple(r) for r in names.linked_pairs(names.resolve(df)).collect()} == set(itertools.combinations(range(len(chain)), 2))


def test_two_edits_meet_without_a_spelling_between(spark):
    long = "".join(chr(97 + i * i % 26) + chr(97 + i * 7 % 23) for i in range(40))  # 80 letters
    pairs = [("zoskemozza", "zoskeoza"), ("abcdefg", "bacdegf"), ("abcdefg", "xbcdefy"), ("kumanosir", "umanosi"), (long[:64], "q" + long[:64] + "q"), (long[:63], long[1:62] + "qq"), (long, "q" + long[1:-1]), (long, long[:10] + "q" + long[10:70] + long[71:]), (long[:65], long[1] + long[0] + long[2:63] + long[64] + long[63])]
    pairs = [p for p in pairs if names.near(*p, names.allowed(*p))]
    assert len(pairs) >= 8
    rows = [(10 * i + j, f"Anna {w}", "person", f"t{i}") for i, p in enumerate(pairs) for j, w in enumerate(p)]
    df = spark.createDataFrame(rows, "entity_id long, name string, etype string, tenant_id string")
    assert {tuple(r) for r in names.linked_pairs(names.resolve(df)).collect()} == {(10 * i, 10 * i + 1) for i in range(len(pairs))}


def test_like_words_against_all_pairs(spark):
    words = sorted({"".join(w) for w in itertools.product("ab", repeat=7)} | {"".join(w) for w in itertools.product("abc", repeat=4)} | {"aaaaaaaa", "abababab", "abababa", "bbbbbbbbb"})
    df = spark.createDataFrame([(t, "person", w, 1000 * n + i) for n, t in enumerate(("t", "u")) for i, w in enumerate(words)], "tenant string, kind string, word string, w long")
    got = {(r.w, r.like) for r in names.like_words(df).collect()}
    want = {(j, i) for (i, a), (j, b) in itertools.combinations(enumerate(words), 2) if names.near(a, b, names.allowed(a, b))}
    assert got == want | {(a + 1000, b + 1000) for a, b in want}


def test_like_sets_against_all_pairs(spark):
    import random

    rnd = random.Random(3)
    pool = ["bank", "first", "national", "nationl", "savings", "saving", "harbor", "harbour", "united", "untied", "trust", "a", "bo"]
    sets = sorted({tuple(sorted(rnd.choices(pool, k=rnd.randint(1, 5)))) for _ in range(300)} | {("bank",) * 3, ("a",)})
    df = spark.createDataFrame([("t", "organization", list(w), i) for i, w in enumerate(sets)], "tenant string, kind string, words array<string>, tid long")
    got = {(r.tid, r.other) for r in names.like_sets(df).collect()}
    assert got == {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i == j or names.same_words(*((a, b) if i < j else (b, a)))}


def test_trades_are_learned(spark):
    owners = ["Smith", "Novak", "Marlow", "Petrov", "Lind", "Okoye", "Tanaka", "Moreau"]
    rows = [f"{o} {t}{x}" for o in owners for t, x in (("Bakery", ""), ("Plumbing", " Ltd"))] + ["Smith Bkry", "Novak Plbg. Ltd", "Marlow Bakeries", "Smith Plumbing"]
    df = spark.createDataFrame([(i, n, "org", "t") for i, n in enumerate(rows)] + [(100, "Smith Bakery", None, "t"), (101, "Bakery Ltd", "org", "t"), (102, "The Bakery", "org", "t")], "entity_id long, name string, etype string, tenant_id string")
    assert set(names.learned_trades(df.selectExpr("entity_id", "name", "etype", "tenant_id"))) == {"bakery", "plumbing"}
    clusters: dict = {}
    for r in names.resolve(df).collect():
        clusters.setdefault(r.cluster, set()).add(r.name)
    assert {"Smith Bakery", "Smith Bkry"} in clusters.values() and {"Novak Plumbing Ltd", "Novak Plbg. Ltd"} in clusters.values() and {"Marlow Bakery", "Marlow Bakeries"} in clusters.values()
    assert {"Bakery Ltd", "The Bakery"} in clusters.values() and not any({"Smith Bakery", "Smith Plumbing"} <= c for c in clusters.values())


def test_hot_surname_and_names_of_one_letter(spark):
    rows = [(i, f"{g} Smith", "person", "t") for i, g in enumerate(["Robert", "Bob", "William", "Bill", "Mary", "R.", "X."])] + [(20 + i, f"Given{chr(97 + i // 26)}{chr(97 + i % 26)} Smith", "person", "t") for i in range(300)] + [(900, "Anna X", "person", "t"), (901, "Anna X", "person", "t"), (902, "X", "org", "t")]
    df = spark.createDataFrame(rows, "entity_id long, name string, etype string, tenant_id string")
    assert {tuple(r) for r in names.linked_pairs(names.resolve(df), block=2).collect()} == {(0, 1), (0, 5), (1, 5), (2, 3), (900, 901)}
