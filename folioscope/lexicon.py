"""Word lists of the name index and the clouds. All lists here are fixed values; results depend on each entry."""

# Words that break a run of capitalised words, unless set in italics with it.
CONNECTORS = frozenset("""
a an and as at but by for from if in into is it no nor not of on or so than that to up with was were are be been being do does
did has have had go goes went will would could should may might can shall this these those there here where when which who
whom whose what how then very also just about over under between through during before after above below each every all both
few more most other some such only own same
""".split())

# Words that are often capitalised because they begin a sentence.
SENTENCE_START = frozenset("""
the a an this these those it its he she we they his her our their there here however although because since while when after
before such many most some several few other another any each every no not if but yet so or for nor as at by from in into on
to with that what which who once then now still also just even
""".split())

# Words of a document's own structure.
STRUCTURAL = frozenset("""
chapter section figure table part volume introduction conclusion abstract references bibliography appendix index contents
preface foreword acknowledgements acknowledgments glossary note notes see also ibid op cit et al ed eds trans rev vol no pp pg
""".split())

TITLES = frozenset("dr mr mrs ms prof rev st sir dame lord lady hon sr jr".split())

# Stop words by default: they cannot begin a name, or be one.
STOPWORDS = frozenset("""
the a an he she it we they i you his her its our their my your him them us me himself herself itself themselves ourselves
this that these those is are was were be been being have has had having do does did will would shall should can could may
might must need ought in on at to for from by with about into through during before after above below between under over up
down out off near around against along across behind beyond within without upon toward towards among amongst beside besides
and but or nor yet so although though because since while when where if unless until whether than however therefore moreover
furthermore nevertheless nonetheless meanwhile consequently subsequently accordingly alternatively additionally specifically
particularly generally typically essentially basically obviously clearly certainly undoubtedly indeed naturally apparently
presumably arguably significantly importantly notably interestingly surprisingly unfortunately fortunately ultimately
eventually initially finally perhaps maybe probably possibly definitely surely some any many much few several each every all
both no none other another either neither most more less least such same own only very also just even still already always
never sometimes often usually quite rather too there here then now today yesterday tomorrow ago how why what which who whom
whose not yes one two three first second third new old good great last next early late once twice again away back long far
soon later earlier almost enough together alone apart
""".split())

# Words that stand in names of places and bodies and are not surnames.
NOT_PERSONS = frozenset("""
north south east west northern southern eastern western central upper lower greater new old grand great little big saint mount
lake river island bay cape fort point springs falls valley hills heights forest beach harbor harbour international national
federal royal general united american british european african asian university institute foundation association corporation
committee commission council department ministry academy society organization organisation company group club museum library
hospital church school college centre center theatre theater gallery stadium memorial monument prize award festival competition
conference congress summit forum olympic street road avenue boulevard square bridge station airport port building tower palace
castle cathedral park state city county district republic kingdom empire province territory professor lecturer dean chancellor
provost director president chairman chairwoman secretary minister ambassador governor baronial gothic medieval colonial baroque
classical neoclassical byzantine renaissance abbey barracks barn cottage estate farm hamlet inn priory rectory vicarage
""".split())

# Months, days and web words that clouds leave out.
CLOUD_STOPWORDS = frozenset("""
http https january february march april may june july august september october november december jan feb mar apr jun jul aug
sep oct nov dec monday tuesday wednesday thursday friday saturday sunday mon tue wed thu fri sat sun
""".split())

# Words without an initial in acronyms.
ACRONYM_SKIP = ("the", "of", "a", "an", "in", "and", "or", "for", "to", "with", "de", "la", "du", "van", "von")
