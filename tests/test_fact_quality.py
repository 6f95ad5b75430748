import json

import pytest

from contrasta.operators import fact_quality as Q

BASE = "http://kg.example.org/resource/"
TEXT = json.dumps({
    "version": "predicate_policy/1.0.0", "hard_reject_predicates": {"p/url": "PREDICATE_EXTERNAL_URL_FIELD"}, "pedagogical_tier_default": 3, "pedagogical_tier": {"p/field": 1, "p/made": 1},
    "pedagogical_tier_by_key": [{"predicate_uri": "p/made", "direction": "IN", "tier": 2}], "templates": [{"predicate_uri": "p/field", "direction": "OUT", "template_id": "OUT_FIELD", "reading": "x"}],
    "object_policy": {"resource_namespace_prefixes": [BASE], "web_archive_hosts": ["archive.org"], "media_file_suffixes": [".jpg"], "maximum_object_label_length": 20, "educational_allowlist": ["https://allowed.example.org/x"]},
    "leakage_policy": {"minimum_token_length": 4},
})


def test_objects_and_order(spark):
    policy = Q.QualityPolicy.from_json(TEXT)
    objects = {
        BASE + "Physics": [], "https://web.archive.org/web/1": ["OBJECT_WEB_ARCHIVE_URL"], "https://notarchive.org/a": ["OBJECT_EXTERNAL_URL"], "https://allowed.example.org/x": [], BASE + "Map_of_it.JPG": ["OBJECT_MEDIA_FILE"],
        BASE + "A_name_that_is_much_too_long": ["OBJECT_LABEL_TOO_LONG"], BASE + "Q12345": ["OBJECT_MACHINE_IDENTIFIER"], BASE + "Carbonado": ["ANSWER_LEXICAL_LEAK"], BASE + "Carbide_42": [], BASE + "(((": [],
    }
    rows = [(BASE + "Carbon", "p/field", "OUT", o) for o in objects] + [(BASE + "Carbon", "p/url", "OUT", BASE + "Physics"), (BASE + "Carbon", "p/made", "IN", BASE + "Physics"), (BASE + "Carbon", "p/made", "OUT", BASE + "Physics")]
    out = Q.assess(spark.createDataFrame(rows, "answer string, predicate string, direction string, object string"), policy)
    got = {(r.predicate, r.direction, r.object): r for r in out.collect()}
    assert {o: got["p/field", "OUT", o].reasons for o in objects} == objects
    assert all(r.eligible == (not r.reasons) for r in got.values())
    assert got["p/url", "OUT", BASE + "Physics"].reasons == ["PREDICATE_EXTERNAL_URL_FIELD"]
    assert [got[k].tier for k in (("p/field", "OUT", BASE + "Physics"), ("p/made", "IN", BASE + "Physics"), ("p/made", "OUT", BASE + "Physics"), ("p/url", "OUT", BASE + "Physics"))] == [1, 2, 1, 3]
    assert got["p/field", "OUT", BASE + "Physics"].template == "OUT_FIELD" and not got["p/made", "OUT", BASE + "Physics"].verbal
    assert got["p/field", "OUT", BASE + "Carbide_42"].soft and not got["p/field", "OUT", BASE + "Physics"].soft
    best = [r.object for r in out.where("eligible and predicate = 'p/field'").orderBy(Q.preference()).collect()]
    assert best[-1] == BASE + "Carbide_42" and best.index(BASE + "(((") < best.index(BASE + "Physics")


def test_policy_files(spark, tmp_path):
    file = tmp_path / "policy.json"
    file.write_text(TEXT)
    assert Q.QualityPolicy.read(spark, str(file)) == Q.QualityPolicy.from_json(TEXT)
    for change in ({"version": "other/1"}, {"pedagogical_tier": {"p": 4}}, {"templates": [{"predicate_uri": "a", "direction": "OUT", "template_id": x} for x in "xy"]}):
        with pytest.raises(ValueError):
            Q.QualityPolicy.from_json(json.dumps(json.loads(TEXT) | change))
