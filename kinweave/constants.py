"""Vocabularies, thresholds and rule tables."""

from __future__ import annotations

# Sources, their census years and dates.
CENSUS_YEAR = {3: 1901, 4: 1911, 5: 1926}
CENSUS_DATE = {3: "1901-03-31", 4: "1911-04-02", 5: "1926-04-18"}

# Controlled vocabularies.
EVENT_TYPES = "birth baptism marriage death burial census residence emigration valuation tithe military_service pension folklore".split()
DATE_QUALIFIERS = "exact about before after between estimated calculated".split()
SOURCE_TYPES = "valuation tithe census birth_registration marriage_registration death_registration parish_register military folklore place_authority".split()
PLACE_TYPES = "province county barony civil_parish ded townland church_parish town".split()
ENTITY_TYPES = "person relationship event person_recorded_person relationship_recorded_relationship event_record place_record".split()
LOG_ACTIONS = "create update delete verify flag".split()
STAGES = "ingest place similarity person relationship event validation fetch conclusion".split()
RELATIONSHIP_TYPES = "couple parent_child sibling".split()

# Thresholds.
CHILD_DEPARTURE_AGE = 20
AUTO_COMMIT_THRESHOLD = 0.85
PROPOSE_FLOOR = 0.30
PERSON_RESOLUTION_THRESHOLD = 0.45
PLACE_THRESHOLD, PLACE_EXACT, PLACE_FUZZY = 0.88, 1.0, 0.90
MEMBER_MATCH_FLOOR, NAME_THRESHOLD = 0.6, 0.85
SEQUENCE_TOLERANCE, LIFESPAN_TOLERANCE, PARENT_TOLERANCE, MARRIAGE_TOLERANCE, BIRTH_BUCKET = 2, 5, 2, 2, 2
PARENT_MIN, MOTHER_MAX, FATHER_MAX, MARRIAGE_MIN = 15, 50, 70, 15
WEAK_SIMILARITY = 0.50
ROLE_PAIR_VERSION = "role_pair_v1.0"

# Unordered role pairs -> relationship type and prior.
ROLE_RULES = (
    ("head", "spouse", "couple", 0.90), ("head", "son", "parent_child", 0.85), ("head", "daughter", "parent_child", 0.85),
    ("head", "mother", "parent_child", 0.85), ("head", "father", "parent_child", 0.85), ("spouse", "son", "parent_child", 0.80),
    ("spouse", "daughter", "parent_child", 0.80), ("head", "sibling", "sibling", 0.80), ("son", "son", "sibling", 0.75),
    ("daughter", "daughter", "sibling", 0.75), ("son", "daughter", "sibling", 0.75),
)

# Years that two ages may differ from the census gap.
AGE_TOLERANCE = {(3, 4): 3, (4, 5): 3, (3, 5): 4}
AGE_TOLERANCE_DEFAULT = 3

# Base score of a finding type, and weight by number of census sources.
FINDING_BASE = {
    "merge_error_candidate": 100, "birth_singularity_violation": 110, "death_singularity_violation": 110, "parent_age_regression": 190,
    "split_person_candidate": 200, "life_event_sequence_violation": 205, "parent_age_implausible": 210, "marriage_age_implausible": 220,
    "lifespan_boundary_violated": 230, "unlinked_in_populated_household": 290, "unlinked_recorded_person": 300, "single_census_appearance": 310,
}
FINDING_DEFAULT = 350
SCOPE_WEIGHT = {3: 0.80, 2: 0.90}
LIVING_EVENTS = "census residence valuation tithe military_service".split()
