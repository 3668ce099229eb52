from loomgraph.operators.linking import canonical_ids
from loomgraph.llm.resolution import Organisations, People, merge_and_rematch, organisation_form, person_name, resolve_organisations, resolve_people, slips

GIVEN = {"robert", "rebecca", "samuel", "katherine", "francisco", "deborah"}


def test_slips():
    assert slips("thoams", "thomas", 1) == 1 and slips("abcd", "abcd", 0) == 0 and slips("abc", "abd", 0) is None and slips("abcdef", "abcxyz", 2) is None and slips("kitten", "sitting", 3) == 3


def test_person_names():
    cases = {"Dr. Samuel Zondrivane": ("zondrivane", ("samuel",)), "ZONDRIVANE, S. R.": ("zondrivane", ("s", "r")), "Zondrivane Bob": ("zondrivane", ("robert",)), "Samule Zondrivane, MD": ("zondrivane", ("samuel",)), "Paco Zon-Drivane": ("drivane-zon", ("francisco",)), "Kathérine Zon Drivane": ("drivane-zon", ("katherine",)), None: ("", ()), " ": ("", ())}
    assert {k: person_name(k, GIVEN) for k in cases} == cases


def same(a, b):
    return Organisations.match(Organisations.parse([organisation_form(a)]), Organisations.parse([organisation_form(b)]))


def test_organisations():
    full = "Zondrivane Mulberrick Memorial Hospital"
    for other in ("ZONDRIVANE MULBERRICK MEMORIAL HOSPITAL", "The Zondrivane Mulberrick Mem. Hosp.", "Memorial Hospital, Zondrivane Mulberrick", "ZondrivaneMulberrick Mem'l Hosp (ZMMH)", "Zondirvane Mulberrick Memorial Hospital", "Zondrivane-Mulberrick Mem."):
        assert same(full, other), other
    for other in ("Zondrivane Mulberrick Regional Medical Center", "Zondrivane Oakmere Memorial Hospital", "Saint Mulberrick Hospital"):
        assert not same(full, other), other
    assert organisation_form("  ") is None and organisation_form(None) is None


def person(*form):
    return People.parse(["\t".join(form)])


def test_people():
    a = person("zondrivane", "robert", "oakmere", "tx", "2155550100", "7", "")
    assert People.match(a, person("zondrivane", "r", "oakmere", "", "", "", ""))
    assert People.match(a, person("zondrivnae", "robert k", "", "tx", "2155550101", "7", ""))
    assert not People.match(a, person("zondrivane", "robert", "elmford", "tx", "2155550100", "7", ""))
    assert not People.match(a, person("zondrivane", "rebecca", "oakmere", "tx", "2155550100", "7", ""))
    assert not People.match(a, person("zondrivane", "robert", "", "tx", "", "", ""))
    assert not People.match(person("x", "", "c", "s", "", "", "1"), person("x", "", "c", "s", "", "", "2"))
    # parts of a surname written as one, in their order; two slips in a short surname only where all else is the same
    assert People.match(person("mulberrick-zondrivane", "robert", "oakmere", "tx", "", "", ""), person("zondrivanemulberick", "robert", "oakmere", "tx", "", "", ""))
    assert People.match(person("fascik", "robert", "oakmere", "tx", "", "7", ""), person("faesick", "robert", "oakmere", "tx", "", "7", ""))
    assert not People.match(person("fascik", "robert", "oakmere", "tx", "", "", ""), person("faesick", "robert", "oakmere", "tx", "", "7", ""))
    assert set(People.keys("\t".join(["mulberrick-zondrivane", "r", "oakmere", "", "", "", ""]))) & set(People.keys("\t".join(["zondrivanemulberrick", "r", "oakmere", "", "", "", ""])))
    assert person_name("Jwnny Oakmere", {"jennifer"})[1] == ("jennifer",)


def test_pet_names_are_a_parameter(spark):
    assert person_name("Zed Oakmere", {"zedekiah"}, pets={"zed": "zedekiah"}) == ("oakmere", ("zedekiah",)) and People.knowing({"zed": "yedekiah"})._one_given("z", "yedekiah") and not People._one_given("z", "yedekiah")
    rows = [(1, "Zed Zondrivane", "Oakmere", "TX", None, None, None), (2, "Zedekiah Zondrivane", "Oakmere", "TX", None, None, None)]
    df = spark.createDataFrame(rows, "record_id long, full_name string, city string, state string, phone string, hospital string, npi string")
    found = lambda pets: {r.entity for r in resolve_people(df, "record_id", "full_name", "city", "state", "phone", "hospital", "npi", resolve_organisations(df, "record_id", "hospital"), pets=pets).collect()}
    assert found({"zed": "zedekiah"}) == {1} and found({"bob": "robert"}) == {1, 2}


def test_rows(spark):
    schema = "record_id long, full_name string, city string, state string, phone string, hospital string, npi string, entity string"
    h = "Zondrivane Mulberrick Memorial Hospital"
    rows = [
        (1, "Dr. Samuel Quellimont", "Oakmere", "TX", "215-555-0100", h, None, "clash"), (2, "QUELLIMONT, S.", "OAKMERE ", "TX", None, h.upper(), None, "clash"), (3, "Samule Quellimont", "Oakmere", "TX", None, None, "11", "clash"),
        (4, "Samuel Quellimont", "Elmford", "OH", "215-555-0199", None, None, "clash"), (5, None, "Oakmere", "TX", None, h, None, "clash"), (6, "Dr. Samuel Quellimont", "Oakmere", "TX", "215-555-0100", h, None, "clash"), (7, "Rebecca Vandersloot", None, None, None, None, None, "clash"),
    ]
    df = spark.createDataFrame(rows, schema)
    orgs = resolve_organisations(df, "record_id", "hospital")
    assert len({r.entity for r in orgs.collect()}) == 1 and orgs.count() == 2
    people = {r.row_id: r.entity for r in resolve_people(df, "record_id", "full_name", "city", "state", "phone", "hospital", "npi", orgs).collect()}
    assert people[1] == people[2] == people[3] == people[6] != people[4] and 5 not in people and people[7] == 7
    empty = df.limit(0)
    assert resolve_people(empty, "record_id", "full_name", "city", "state", "phone", "hospital", "npi", resolve_organisations(empty, "record_id", "hospital")).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 99), (7, 7), (200, 150)]
    got = {r.id: r.canonical for r in canonical_ids(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 99: 99, 100: 99, 101: 99, 150: 150, 200: 150}


def test_rounds_end_only_when_nothing_merges(spark):
    class Chain:
        """Numbers match if together they are 0 to n; each round can add one to what is merged, since the last number comes first."""

        @staticmethod
        def parse(forms):
            return {"has": {int(f) for f in forms}}

        @staticmethod
        def keys(form, long=False):
            return ["k"]

        @staticmethod
        def match(a, b):
            both = a["has"] | b["has"]
            return both == set(range(len(both)))

    n = 9
    got = merge_and_rematch(spark.createDataFrame([(n - i, str(i)) for i in range(n)], "fid long, form string"), Chain).collect()
    assert {r.entity for r in got} == {1}


def test_crowded_blocks_are_matched_whole(spark):
    # both ends of the first two differ, so they meet by the shared word only
    names = ["zondrivane mulberrick oakmereton", "zandrivane mulberrick oakmeretan", *(f"{a} mulberrick {b}" for a, b in (("quell", "vandersloot"), ("ashgrove", "imont"), ("tarrow", "penhaligon"), ("fennimore", "dusk"), ("brack", "hollowell"), ("lindenholt", "ray")))]
    forms = spark.createDataFrame([(i, "|" + n) for i, n in enumerate(names)], "fid long, form string")
    for most in (2, 3, 2_000):
        assert {r.fid: r.entity for r in merge_and_rematch(forms, Organisations, max_block=most).collect()} == {0: 0, 1: 0, **{i: i for i in range(2, 8)}}, most
