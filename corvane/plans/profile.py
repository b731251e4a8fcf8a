"""The node words, lexical field, lists and rules that the driver's queries use; all of them are parameters of the operators.

The driver's tables have no musical vocabulary, so they are words of those tables.
"""

NODES = ["thing", "thble", "thtion", "nicht", "the", "der", "la"]
FIELD = {"erble": ["erble*"], "onin": ["onin*"], "ther": ["ther*"], "ertion": ["ertion", "erti*"], "attion": ["atti*"], "eren": ["eren*"], "pair": ["of this", "with th*"]}
STABLE, VARIABLE = ["erble", "onin", "ther"], ["ertion", "attion", "eren"]
SYNCHRONIC, DIACHRONIC = ["erble", "onin", "attion"], ["ther", "ertion", "onin"]
COPULAS = ["is", "was", "be", "are", "ist", "est", "es"]
NEGATIONS = ["no", "not", "nicht", "ne"]
DEGREES = ["for", "with", "this"]
MODALS = ["or", "by"]
NEAR, BAND = 4, 12

#: Domains by path, the ones that count, and the one of paths without a rule.
RULES = [(r"^src0/", "core"), (r"^src1[0-9]/", "edge"), (r"^src[1-6]/", "wide")]
INCLUDED, DEFAULT_DOMAIN = ["core", "wide"], None
FRIENDS = {"onin": "fora_de_dominio", "thered": "fora_da_classe", "with the": "fora_da_classe"}
#: Cues in the window, the first domain that has one.
CUES = {"legal": ["license", "copyright"], "contact": ["e-mail", "phone", "@"]}
