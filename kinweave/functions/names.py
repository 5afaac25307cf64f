"""Forename variants and genders, and columns that use them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A forename and its approved variants.
VARIANTS = """
alice: anna anne annie alicia
anna: alice anne annie ann
anne: alice anna annie ann
annie: alice anna anne ann
ann: alice anna anne annie
margaret: maggie meg maggy margie
maggie: margaret meg maggy margie
meg: margaret maggie maggy margie
elizabeth: liz lizzie liza eliza betty beth
lizzie: elizabeth liz liza eliza betty beth
liz: elizabeth lizzie liza eliza betty beth
mary: marie molly moll m
molly: mary marie moll
catherine: kate kathryn cathy catharine
kate: catherine kathryn cathy catharine
kathleen: kate kathy kay
josephine: josephina jo josie
josephina: josephine jo josie
william: liam will bill willie wm
liam: william will bill willie
bill: william liam willie wm
wm: william bill
francis: frank fran frankie ffrancis
frank: francis fran frankie
edward: ed eddie ted
eddie: edward ed ted
robert: rob robbie bob bobby
robbie: robert rob bob bobby
bob: robert robbie bobby
michael: mick mike mikey micol
mick: michael mike mikey
mike: michael mick mikey
james: jim jimmy jas jem
jim: james jimmy jas
jimmy: james jim
john: jack johnny jon sean
jack: john johnny
johnny: john jack
sean: john johnny jack
thomas: tom tommy thom
tom: thomas tommy
tommy: thomas tom
patrick: pat patty paddy pádraig
pat: patrick paddy
paddy: patrick pat
daniel: dan danny
dan: daniel danny
danny: daniel dan
henry: harry hank
harry: henry hank
charles: charlie chuck chas
charlie: charles chuck chas
chuck: charles charlie
"""

# Forenames of one gender.
MALE = """
william liam will bill willie wm francis frank frankie ffrancis edward ed eddie ted robert rob robbie bob bobby michael mick
mike mikey james jim jimmy jas jem john jack johnny jon sean thomas tom tommy thom patrick paddy pádraig daniel dan danny henry
harry hank charles charlie chuck chas richard rick dick ricky joseph joe joey george georgie anthony tony ant peter pete paul
paulo stephen steve steven andrew andy brian bryan martin marty kevin kev david dave davy owen bertram bert humphrey humphry
lawrence larry laurence gerald gerry oliver ollie terence terry
""".split()
FEMALE = """
mary marie molly moll margaret maggie meg maggy margie elizabeth liz lizzie liza eliza betty beth catherine kate kathryn cathy
catharine kathleen kathy kay josephine josephina jo josie alice anna anne annie ann susan sue suzanne patricia barbara barb sarah
sara sally jessica jess jessie janet jane janey jean jeanie helen helena sandra sandy ashley ash theresa teresa frances francie
dorothy dot dotty gloria rose rosie joyce diane dianne evelyn eve joan joanne christine christie chris chrissie carolyn carol
carole rachel maria nora norah bridget brigid bridie bride monica moira siobhan siobhán sheila
""".split()


def variants() -> dict[str, set[str]]:
    return {k: set(v.split()) for k, v in (line.split(":") for line in VARIANTS.strip().splitlines())}


def pairs() -> set[tuple[str, str]]:
    """Approved pairs, in both directions."""
    direct = {(k, v) for k, vs in variants().items() for v in vs}
    return direct | {(b, a) for a, b in direct}


def canonical() -> dict[str, str]:
    """For each known forename the longest name one step away; of equal lengths the first in order."""
    table = variants()
    out = {}
    for name in {*table, *(v for vs in table.values() for v in vs)}:
        near = {name} | table.get(name, set())
        for key, vs in table.items():
            if name in vs:
                near |= {key} | vs
        out[name] = min(near, key=lambda x: (-len(x), x))
    return out


def _lookup(table: dict[str, str], key: Column) -> Column:
    entries = [x for k, v in sorted(table.items()) for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*entries), key)


def first_token(name: Column) -> Column:
    return F.element_at(F.split(F.lower(F.trim(name)), r"\s+"), 1)


def canonical_forename(forename: Column) -> Column:
    """The canonical form of a normalised forename; itself where unknown."""
    return F.coalesce(_lookup(canonical(), forename), forename)


def forename_class(forename: Column) -> Column:
    """exact for a dictionary key, approved for a variant, else suspicious (also for null), by the first token."""
    table = variants()
    kind = {v: "approved" for vs in table.values() for v in vs} | dict.fromkeys(table, "exact")
    return F.coalesce(_lookup(kind, first_token(forename)), F.lit("suspicious"))


def infer_gender(name: Column) -> Column:
    """M or F by the first token, male names first; null where neither."""
    return _lookup(dict.fromkeys(FEMALE, "F") | dict.fromkeys(MALE, "M"), first_token(name))


def is_variant(a: Column, b: Column) -> Column:
    """Approved pair of first tokens, in either direction."""
    table: dict[str, list[str]] = {}
    for x, y in sorted(pairs()):
        table.setdefault(x, []).append(y)
    entries = [x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    return F.coalesce(F.array_contains(F.try_element_at(F.create_map(*entries), a), b), F.lit(False))
