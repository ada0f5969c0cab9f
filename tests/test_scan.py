"""The text scan's parts, by tables of examples."""

import pytest

from tellal.functions import scan
from tellal.functions.scan import Scanner, keyword_pattern, normalise, numbers, sentences
from tellal.sources.catalog import load_catalog
from tellal.sources.reference_data import PROVINCES


def found(text):
    return [n[0] for n in numbers(normalise(text)[0])]


@pytest.mark.parametrize(
    "text, values",
    [
        ("bir", [1]), ("on dokuz", [19]), ("doksan dokuz", [99]), ("yüz yirmi", [120]), ("iki yüz bin", [200_000]), ("3 milyon", [3_000_000]), ("12.345", [12345]), ("15 20", [15, 20]),
        ("yüz yüz kişi", [100, 100]), ("bin milyon", [1000, 1_000_000]), ("milyar milyar", [10**9, 10**9]), ("O-4 otoyolunda trafik kazası", []), ("yaralılardan ikisi taburcu oldu", []),
        ("3 Mayıs 2020 günü İzmir'de deprem oldu", [3, 2020]), ("9223372036854775807 milyar", [9223372036854775807, 10**9]), ("1.5", [1, 5]), ("2,5 milyar", []), ("", []),
        ("Son 24 saatte Bursa'da 8, Kocaeli'nde 6 trafik kazası. Bursa'da 1, Kocaeli'nde ise 2 kişi. Her iki ilde toplam 10 kişi", [24, 8, 6, 1, 2, 2, 10]),
    ],
)
def test_numbers(text, values):
    assert found(text) == values


def test_notation():
    assert [numbers(t)[0][3] for t in ("on iki", "15", "15 bin")] == ["WORDS", "DIGITS", "MIXED"]


def test_normalised_text_keeps_its_source():
    assert normalise("sel\n\n  var") == ("sel var", [0, 1, 2, 3, 7, 8, 9], [1, 2, 3, 7, 8, 9, 10])
    assert normalise("üç")[0] == "üç"
    assert normalise("Bursa´da Ankara`da")[0] == "bursa'da ankara'da"
    assert normalise("   ")[0] == "" and normalise("")[0] == ""


@pytest.mark.parametrize("text", ["", "   ", "...", "!?"])
def test_no_sentence(text):
    assert sentences(normalise(text)[0]) == []


@pytest.mark.parametrize(
    "keyword, text, hit",
    [
        ("vaka", "vakalarda", True), ("hayatını kaybet", "hayatını kaybederken", True), ("test", "testere", False), ("kaza", "kazan", False), ("sel", "selam", False),
        ("trafik kazası", "trafik kazasından", True), ("yasak", "yasağa", True), ("ağaç", "ağaca", True), ("kitap", "kitabı", True), ("su baskını", "su  baskınında", True),
    ],
)
def test_keywords(keyword, text, hit):
    assert bool(keyword_pattern(keyword).search(normalise(text)[0])) == hit


def test_all_provinces_are_found_by_their_names():
    scanner = Scanner(load_catalog(), dict(enumerate(PROVINCES, 1)))
    for code, name in enumerate(PROVINCES, 1):
        hits = [h for h in scanner.hits(normalise(f"{name} ili")[0]) if h["kind"] == "PROVINCE"]
        assert [h["detail"] for h in hits] == [str(code)]
    with pytest.raises(ValueError):
        Scanner(load_catalog(), {})


def test_no_pattern_is_compiled_for_a_text(monkeypatch):
    scanner = Scanner(load_catalog(), dict(enumerate(PROVINCES, 1)))
    monkeypatch.setattr("tellal.functions.scan.re.compile", None)
    for a, b in zip(PROVINCES, PROVINCES[1:]):
        hits = scanner.hits(normalise(f"{a}'da 3, {b}'nde 4 kişi hayatını kaybetti.")[0])
        assert [h["key"] for h in hits if h["kind"] == "PROVINCE"] == [normalise(a)[0], normalise(b)[0]]


HINTED = [
    "Bursa'da 8 kişi", "(van", "geçtiğimiz hafta", "son yirmi dört saatte", "son 3\u00a0gün", "bu sabah", "önceki gün", "evvelki  gün", "dünkü", "bugün", "3 Mayıs'ta", "٣٫٤ ٣.٤.٢٠٢٠", "1-2-2020", "2020-01-05",
    "iki ilde", "3\u00a0şehirde", "illerde", "şehirler", "on bir", "x.bin,y", "1", "éon", "on_", "(yüz)", "sel", "trafik kazası", "hayatını  kaybetti", "yaralandı;kaza",
]


def test_hints_rule_out_nothing_that_is_there():
    import pyarrow as pa
    import pyarrow.compute as pc

    scanner = Scanner(load_catalog(), dict(enumerate(PROVINCES, 1)))
    values = [normalise(t)[0] for t in [*HINTED, *PROVINCES, *scanner.keywords]]
    left = {k: pc.match_substring_regex(pa.array(values), h).to_pylist() for k, h in scanner.hints.items()}
    counted = pc.match_substring_regex(pa.array(values), scan.NUMBER_HINT).to_pylist()
    for k, value in enumerate(values):
        assert scanner.hits(value, [kind for kind in left if left[kind][k]]) == scanner.hits(value)
        assert counted[k] or not numbers(value)
    assert not any(x[k] for x in left.values() for k in (HINTED.index("1"), HINTED.index("(yüz)"))) and not counted[HINTED.index("éon")] * numbers("éon")


def test_a_text_without_hints_is_not_searched(monkeypatch):
    from tellal.operators import extraction

    scanner = Scanner(load_catalog(), dict(enumerate(PROVINCES, 1)))
    monkeypatch.setattr(Scanner, "hits", None)
    monkeypatch.setattr(extraction, "numbers", None)
    value, rows, failures = extraction.read_texts(scanner, ["The  cars went by. A person saw it!", None])
    assert value.to_pylist() == ["the cars went by. a person saw it!", None] and failures[0] is None and failures[1] == "ValueError: text must not be null"
    assert rows == [([(0, 17), (18, 34)], [], []), (None, None, None)]


def test_only_the_parts_asked_for_are_looked_for():
    from tellal.operators import extraction

    scanner = Scanner(load_catalog(), dict(enumerate(PROVINCES, 1)))
    whole = extraction.read_texts(scanner, ["Dün Bursa'da iki kişi öldü. Kaza sürüyor."])[1][0]
    assert all(whole)
    for k, part in enumerate(extraction.PARTS):
        assert extraction.read_texts(scanner, ["Dün Bursa'da iki kişi öldü. Kaza sürüyor."], (part,))[1][0] == tuple(x if j == k else [] for j, x in enumerate(whole))


def test_plain_characters_are_told_by_their_ranges():
    strange = [c for c in map(chr, range(0x3100)) if not scan.SUSPECT.match(c) and (scan.NOT_PLAIN.match(c) or normalise(c)[0] != scan._normalise_clusters(c)[0])]
    assert strange == []


@pytest.mark.parametrize("text, parts", [("1.234,5", [(1234, 2, 0, 5), (5, 2, 6, 7)]), ("12,5 bin", [(None, 2, 0, 4), (1000, None, 5, 8)]), ("onbir on", [(10, 1, 6, 8)]), ("1234.567", [(1234, 2, 0, 4), (567, 2, 5, 8)])])
def test_parts_of_numbers(text, parts):
    assert scan.number_parts(text) == parts
