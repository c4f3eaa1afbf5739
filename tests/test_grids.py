"""Tables of pages from placed words."""

from clausewise.operators import grids

WORDS = "page int, x0 double, y0 double, x1 double, y1 double, text string, font string"


def words(spark, lines, page=1):
    """Lines of (x, text) cells; each word is 6 wide a letter, lines are 12 apart."""
    rows = []
    for k, line in enumerate(lines):
        for x, text in line:
            for w in text.split(" "):
                rows.append((page, float(x), 12.0 * k, float(x + 6 * len(w)), 12.0 * k + 10, w, "f"))
                x += 6 * len(w) + 6
    return spark.createDataFrame(rows, WORDS)


def found(df):
    return [(r["page"], r["n_rows"], r["n_cols"], r["text"]) for r in grids.tables(df, ["page"]).orderBy("page").collect()]


def test_cells_are_parted_by_tabs_and_rows_by_line_feeds(spark):
    lines = [[(0, "name"), (100, "unit price"), (200, "n")], [(0, "a long bolt"), (100, "12"), (200, "3")], [(0, "nut"), (200, "44")]]
    assert found(words(spark, lines)) == [(1, 3, 3, "name\tunit price\tn\na long bolt\t12\t3\nnut\t\t44")]


def test_a_line_across_columns_stands_where_it_covers_most(spark):
    lines = [[(0, "x" * 12 + " yyy")]] + [[(0, "k"), (60, "v"), (120, "w")]] * 6
    text = found(words(spark, lines))[0][3].split("\n")
    assert text[0] == "\t" + "x" * 12 + " yyy" + "\t"
    assert text[1:] == ["k\tv\tw"] * 6


def test_pages_without_a_grid_give_nothing(spark):
    prose = [[(0, "the words of a page of prose stand close")], [(0, "and lines of it have no gap that they share")], [(0, "short one")]]
    single = [[(0, "a"), (100, "b")]]
    column = [[(0, "one")], [(0, "two")], [(0, "three")]]
    for lines in (prose, single, column):
        assert found(words(spark, lines)) == []
    assert found(spark.createDataFrame([], WORDS)) == []


def test_blank_words_broken_boxes_and_nulls_are_left_out(spark):
    lines = [[(0, "a"), (100, "b")], [(0, "c"), (100, "d")]]
    odd = [(1, 50.0, 0.0, 60.0, 10.0, " ", "f"), (1, 50.0, 0.0, 40.0, 10.0, "z", "f"), (1, None, 0.0, 60.0, 10.0, "z", "f"), (1, 50.0, 0.0, 60.0, 10.0, None, "f")]
    df = words(spark, lines).unionByName(spark.createDataFrame(odd, WORDS)).unionByName(words(spark, lines[:1], page=2))
    assert found(df) == [(1, 2, 2, "a\tb\nc\td")]


def test_words_that_do_not_stand_on_one_height_are_one_line(spark):
    rows = [(1, 0.0, 0.0, 6.0, 10.0, "a", "f"), (1, 100.0, 3.0, 106.0, 13.0, "b", "f"), (1, 0.0, 14.0, 6.0, 24.0, "c", "f"), (1, 100.0, 13.5, 106.0, 22.0, "d", "f")]
    assert found(spark.createDataFrame(rows, WORDS)) == [(1, 2, 2, "a\tb\nc\td")]
