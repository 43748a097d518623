"""The two composed flows, end to end on hand-made rows."""

from helpers import MONDAY, lounge_row, lounges

from concourse.plans import flows

CARD = '<li class="c"><a href="https://x/lounges/{0}?r=1">{1}<p data-testid="outlet-card-terminal">{2}</p><p>Hours: 05:00 - 22:00</p></a></li>'


def test_pages_to_catalog(spark):
    html = ('<h1 data-testid="airport-name">Heath</h1><b data-testid="airport-code">LHR</b><ul>' + CARD.format("b", "<h4> B </h4>", "2")
            + '<li><a href="/about">x</a></li>' + CARD.format("a", "<h4>A</h4>", "1") + CARD.format("bad", "", "3") + "</ul>")
    pages = spark.createDataFrame([(1, "u1", html), (2, "u2", "<p>nothing</p>"), (3, "u3", "")], "page_id long, url string, html string")
    detail = '<p class="am"><span>Wi-Fi</span></p><button><h2>Conditions</h2></button><div><li>Max 3 hours</li></div>'
    details = spark.createDataFrame([("https://x/lounges/a?r=1", detail)], "url string, html string")
    r = {x.url: x for x in flows.catalog_from_pages(pages, details).collect()}
    assert [(y.lounge_id, y.name, y.terminal, y.amenities, y.conditions) for y in r["u1"].lounges] == [
        ("b", "B", "2", "N/A", []), ("a", "A", "1", "Wi-Fi", ["Max 3 hours"])]
    assert (r["u1"].airport_code, r["u1"].airport_name, r["u1"].total_experiences) == ("LHR", "Heath", 2)
    assert r["u2"].lounges == [] == r["u3"].lounges and r["u2"].airport_code == "N/A" and r["u2"].airport_name == "u2"


def test_text_to_advisory(spark):
    cities = spark.createDataFrame([(0, "PARIS"), (1, "OSLO")], "city_key long, city string")
    texts = spark.createDataFrame([
        (1, "FLIGHT BER167 PARIS (A01) → OSLO GATE: B12 BOARDING TIME 09:40"),
        (2, "FLIGHT BA2 PARIS OSLO TERMINAL: 2 TIME 10:00"),
        (3, "FLIGHT BA3 PARIS → OSLO TERMINAL 9 GATE C1")], "pass_id long, text string")
    texts = texts.replace("FLIGHT BER167 PARIS (A01) → OSLO GATE: B12 BOARDING TIME 09:40",
                          "FLIGHT BER167 PARIS (AAA) → OSLO GATE: B12 BOARDING TIME 09:40", "text")
    requests = spark.createDataFrame([(i, MONDAY.replace(hour=9), None if i == 1 else "AAA") for i in (1, 2, 3)],
                                     "pass_id long, now_ts timestamp_ntz, airport_code string")
    own = lounges(spark, [lounge_row("L1", "08:00 - 20:00", "2", "AAA"), lounge_row("L2", "08:00 - 20:00", "B", "AAA"),
                          lounge_row("L3", "N/A", "2", "AAA")])
    routes = spark.createDataFrame([], "origin string, dest string, minutes int")
    edits = spark.createDataFrame([(3, "AAA", "", "", "Rome", "2", "", "", "", "")],
                                  "pass_id long, airport_iata string, airport_city string, dest_iata string, dest_city string, "
                                  "terminal string, gate string, flight string, departure string, boarding string")
    r = {x.pass_id: x for x in flows.advise_from_text(texts, requests, cities, own, routes, edits).collect()}
    assert [y.lounge_id for y in r[1].recommendations] == ["L2", "L1"]
    assert "inferred from your gate" in r[1].recommendations[0].why_recommended   # not "same terminal"
    assert sum("Terminal inferred as B" in a for a in r[1].assumptions) == 1
    assert any("No direction marker" in a for a in r[2].assumptions) and r[2].recommendations[0].lounge_id == "L1"
    assert "Same terminal" in r[2].recommendations[0].why_recommended
    assert r[3].destination_context.city == "Rome" and not any("No direction" in a for a in r[3].assumptions)
    assert r[3].recommendations[0].why_recommended.startswith("Same terminal as your flight (2)")
