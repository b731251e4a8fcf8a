"""Lists and patterns that results depend on, kept as they are defined, in their own order.

All of them are defaults of parameters; corvane.sources.lexicon reads others from files.
"""

# Words after which a stop does not end a sentence.
ABBREVIATIONS = "al apr aug bk bwv c ca cf chap chaps cit d dec diss dr e.g ed eds esp et etc ex exx feb fig figs hob i.e ibid jan jul jun k kv mar mr mrs ms mss n no nos nov oct op p pp prof publ repr rev sec secs sep sept st trans univ viz vol vols".split()

# Word lists of the linear annotation.
COPULAS = "appear appeared appears are be became become becomes been being is remain remained remains seem seemed seems stayed stays was were".split()
DEGREES = "almost broadly certain comparatively completely entirely essentially fairly fully generally highly increasingly largely less more mostly nearly quite rather relatively slightly some somewhat very virtually".split()
MODALS = "apparently appear appears arguably can could likely may might must parece perhaps pode poderia possibly presumably seem seemingly seems should suggests talvez tends unlikely would".split()
NEGATIONS = "absence aren barely cannot devoid doesn don hardly isn lack lacking n't neither never nor not rarely scarcely seldom wasn weren without".split()

# Node words by language.
NODES = {
    "de": "textur texturen".split(),
    "en": "textural texturally texture textured textures texturing".split(),
    "fr": "texture textures textural".split(),
    "pt": "textura texturais textural texturas".split(),
}
NODE_PREFIX = "textur"

# The two poles, the two axes, and their names.
STABLE = "consistent constant homogeneous immutable invariable monotonous regular stable static steady sustained unchanging uniform unvarying".split()
VARIABLE = "changing diverse heterogeneous irregular multiform mutable unequal varied varying".split()
POLES = ("estabilidade", "variabilidade")
SYNCHRONIC = "uniform homogeneous heterogeneous diverse varied unequal irregular multiform mutable".split()
DIACHRONIC = "static invariable unvarying immutable unchanging constant varying changing stable steady sustained monotonous consistent regular".split()
AXES = ("homogeneidade_sincronica", "invariancia_diacronica", "ambos")

# Relations that count as nuclear, and those that do not.
NUCLEAR = "adverbial atributiva nominal_composto nominal_genitiva predicativa predicativa_secundaria".split()
NOT_NUCLEAR = "adverbial_de_grau adverbial_verbal coordenada incidental indeterminada".split()

# Forms that look like terms and are none, with the motive they are excluded by.
FALSE_FRIENDS = {
    "constants": "fora_de_dominio",
    "continua": "fora_da_classe_uniforme",
    "continuation": "termo_nao_relacionado_directamente_com_textura",
    "continue": "termo_nao_relacionado_directamente_com_textura",
    "continues": "termo_nao_relacionado_directamente_com_textura",
    "continuo": "termo_nao_relacionado_directamente_com_textura",
    "continuum": "fora_da_classe_uniforme",
    "continuums": "fora_da_classe_uniforme",
}

# Domains, where each may come from, and the path rules and cues, the first match first.
DOMAIN_SOURCES = {
    "artes_visuais": "janela",
    "ciencias_naturais": "path",
    "ecolocalizacao": "janela",
    "fala": "janela",
    "gastronomia": "janela",
    "geologia": "janela",
    "haptica_materiais": "janela",
    "matematica": "path",
    "mir_visao": "path",
    "musicologia": "path",
    "outro": "path",
    "por_rever": "sistema",
    "texto_social": "janela",
}
DOMAIN_DEFAULT = "musicologia"
DOMAIN_CUES = {
    "geologia": ["dolomite", "breccia", "facies", "bioclast", "waulsortian", "sedimentar", "mineralog", "sediment", "mineral"],
    "artes_visuais": ["painting", "paintings", "mural", "canvas", "flat plane", "aaron douglas"],
    "haptica_materiais": ["haptic", "tactile", "knitting needles", "materials library", "knitting", "fabric swatch"],
    "ecolocalizacao": ["echolocation", "bat-inspired", "bat inspired", "sonar"],
    "fala": ["speech recognition", "speech waveform", "voice conversion"],
    "texto_social": ["social texture", "reading and writing"],
    "gastronomia": ["fine dining", "flavors", "flavours"],
}

# Patterns of metatext (keywords between word borders, initials, numbered headings, captions) and the vowels of words.
# A keyword that ends in a mark must be followed by a word character, any other must not.
METATEXT_WORDS = r"ieee|arxiv|isbn|doi|proceedings|symposium|journal of|this content downloaded from|filomat|jstor\.org/terms|all rights reserved|tandfonline\.com|terms of use"
METATEXT_MARKS = r"trans\.|pp\.|vol\.|author\(s\):|copyright\s*©"
INITIALS = r"(?:[A-Z]\.){2,}"
HEADING = r"^\p{Nd}+(?:\.\p{Nd}+)+\s"
CAPTION = r"^(?i:fig(?:ure)?|table|example|ex)\.?\s*\p{Nd}"
VOWELS = "aeiouáéíóúàèìòùâêîôûäëïöü"

# Words of the query engine's syntactic relations, and the ends of words that were run together.
SPECIFYING = "of with without as".split()
DETERMINERS = "the a an this that these those its his her their our any some no each every both such".split()
QUERY_DEGREES = "very quite rather more most less least so too highly fairly somewhat increasingly relatively extremely slightly almost nearly entirely wholly purely truly especially particularly remarkably".split()
QUERY_NEGATIONS = "not never n't".split()
CHARACTERISING = "called termed named described defined characterized characterised regarded considered known labelled labeled".split()
GLUED_ENDS = "and the of for with from into onto kinds spaces introduced determining morphisms bicontinuous discrete".split()

# Review tags, and those that take a detail.
TAGS = "genitiva_por_complemento atributiva_via_conj atributiva_coordenada".split()
TAG_PREFIXES = "coordenacao_heterogenea: associativa_com_nao_textural: dominio_janela:".split()

# Heads that are no texture, for the second opinion on relations.
OTHER_HEADS = """melody melodies melodic rhythm rhythms rhythmic rhythmical harmony harmonies harmonic timbre timbres pitch pitches
dynamics instrument instruments voice voices colour colours color colors lyric lyrics text texts theme themes thematic tempo tempi
register registers structure structures flavor flavors flavour flavours space spaces imagery notation meter meters metre metres tone
tones pattern patterns gesture gestures effect effects perception perceptions time development developments""".split()

# Short words that an excerpt may end in before it is cleaned, and function words that are peeled off its end.
SHORT_WORDS = """a an the or and of in on to for by as is it at no not so if we he she be do am are was were its his her their our your
this that these those with from into onto over under than then also only both such per via vs etc um uma o a os as de do da dos das em
no na nos nas e ou que se""".split()
