"""The closed vocabularies of the graph."""

PREDICATES_BY_KIND = {
    "character": "ABANDONS ALLIES_WITH AVENGES BETRAYS BLAMES CONFRONTS ENVIES FORGIVES HATES KILLS LIES_TO LOVES MANIPULATES OWES PROTECTS RECONCILES_WITH SACRIFICES_FOR SAVES TEACHES THREATENS".split(),
    "concept": "ACCEPTS BELIEVES CREATES DESTROYS DISCOVERS DOUBTS FEARS INHERITS LEARNS LOSES MASTERS POSSESSES REJECTS REVEALS SEEKS WANTS".split(),
    "transformation": "CORRUPTS REALIZES REDEEMS TRANSFORMS_INTO".split(),
    "social": "CHILD_OF LEADS MARRIED_TO PARENT_OF SIBLINGS_WITH WORKS_FOR".split(),
}
PREDICATES = sorted(p for kind in PREDICATES_BY_KIND.values() for p in kind)
ENTITY_TYPES = sorted("EVENT FAC GPE LOC NORP ORG PERSON WORK_OF_ART".split())
#: Predicates that nobody can hold towards themselves.
NOT_REFLEXIVE = sorted("BETRAYS CONFRONTS KILLS LIES_TO TEACHES".split())
