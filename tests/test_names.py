import pytest
from pyspark.sql import functions as F

from tickscope.functions.names import base_name, item_name, item_type, version, versioned_name

KNIFE = "★ Butterfly Knife | Doppler (Phase 3) (Factory New)"


@pytest.mark.parametrize("raw, name, kind", [
    ("AK-47%20%7C%20Redline%20(Field-Tested).csv", "AK-47 | Redline (Field-Tested)", "Weapon Skin"),
    ("%E2%98%85%20Karambit%20%7C%20Doppler%20(Factory%20New).csv", "★ Karambit | Doppler (Factory New)", "Knife"),
    ("★ Hydra Gloves | Emerald (Field-Tested)", "★ Hydra Gloves | Emerald (Field-Tested)", "Glove"),
    ("★ Hand Wraps | Leather (Well-Worn)", "★ Hand Wraps | Leather (Well-Worn)", "Glove"),
    ("Sticker%20%7C%20Titan%20%7C%20Katowice%202014.csv", "Sticker | Titan | Katowice 2014", "Sticker"),
    ("Music Kit | AWOLNATION", "Music Kit | AWOLNATION", "Music Kit"),
    ("Patch | Crazy Banana", "Patch | Crazy Banana", "Patch"),
    ("Special Agent Ava | FBI", "Special Agent Ava | FBI", "Agent"),
    ("Clutch Case", "Clutch Case", "Container/Collectible"),
    ("Guardian Pin", "Guardian Pin", "Container/Collectible"),
    ("Some Character", "Some Character", "Agent"),
    ("a+b 100%.csv", "a+b 100%", "Agent"),
    ("50%25%zz%20x", "50%%zz x", "Agent"),
])
def test_decode_and_classify(value, raw, name, kind):
    assert value(item_name(F.lit(raw))) == name
    assert value(item_type(F.lit(name))) == kind


def test_classification_is_case_sensitive(value):
    assert value(item_type(F.lit("sticker thing (Field-Tested)"))) == "Weapon Skin"


@pytest.mark.parametrize("name, base, parsed", [
    (KNIFE, "★ Butterfly Knife | Doppler (Factory New)", "Phase 3"),
    ("★ Bayonet | Doppler (Ruby) (Minimal Wear)", "★ Bayonet | Doppler (Minimal Wear)", "Ruby"),
    ("AK-47 | Redline (Field-Tested)", "AK-47 | Redline (Field-Tested)", None),
    ("Sticker | Titan (Holo)", "Sticker | Titan (Holo)", None),
    ("X () (Field-Tested)", "X () (Field-Tested)", None),
    ("X (a(b)) (Field-Tested)", "X (a(b)) (Field-Tested)", None),
])
def test_version_parsing(value, name, base, parsed):
    assert value(base_name(F.lit(name))) == base
    assert value(version(F.lit(name))) == parsed


@pytest.mark.parametrize("name, wanted, built", [
    ("AK-47 | Redline (Field-Tested)", "Phase 3", "AK-47 | Redline (Phase 3) (Field-Tested)"),
    ("AK-47 | Redline", "Phase 3", "AK-47 | Redline (Phase 3)"),
    ("AK-47 | Redline (Field-Tested)", None, "AK-47 | Redline (Field-Tested)"),
    ("AK-47 | Redline (Field-Tested)", "", "AK-47 | Redline (Field-Tested)"),
    ("AK-47 | Redline (Field-Tested)", "default", "AK-47 | Redline (Field-Tested)"),
])
def test_version_building(value, name, wanted, built):
    assert value(versioned_name(F.lit(name), F.lit(wanted).cast("string"))) == built


def test_round_trip(value):
    name = F.lit(KNIFE)
    assert value(versioned_name(base_name(name), version(name))) == KNIFE
