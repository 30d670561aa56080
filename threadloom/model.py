"""Fixed values of the data model: link verbs, their aliases, stop lists and table schemas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The seeded verbs (name, directed, inverse of, description).
LINKAGES = [
    ("mentions", 1, None, "entity mentions concept"),
    ("defines", 1, None, "entity defines concept"),
    ("calls", 1, None, "function calls function"),
    ("called_by", 1, "calls", "inverse of calls"),
    ("imports", 1, None, "entity imports module or concept"),
    ("is_a", 1, None, "concept is a subtype of concept"),
    ("related-to", 0, None, "undirected association"),
    ("specifies", 1, None, "plan or spec specifies concept"),
    ("specified_by", 1, "specifies", "inverse of specifies"),
    ("same_as", 0, None, "concept is the same as a canonical concept"),
    ("reinforces", 1, None, "memory raises confidence in a concept"),
    ("contradicts", 1, None, "memory lowers confidence in a concept"),
    ("recalls", 1, None, "memory recalls a concept"),
    ("informs", 1, None, "memory informs a concept"),
]
#: Spellings that denote another verb.
VERB_ALIASES = {"related_to": "related-to"}

# Words that body term counts leave out.
BODY_STOPWORDS = (
    "the and for with from this that have has had are was were but not any all can will would should could into out off via per non such "
    "than then when where what which while after before user you your they them their its it's don't wasn't isn't doesn't didn't"
).split()

# Function words that search terms leave out where others remain.
SEARCH_STOPWORDS = (
    "a an the this that these those and or but nor if so yet of to in on at by for with from into onto off per via as about "
    "i we me my us our you your he she it they them their how why who whom whose what which when where while "
    "is am are was were be been being do does did doing done have has had can could will would should shall may might must "
    "not no yes than then such one"
).split()

ENTITY = "id BIGINT, partition_id INT, kind STRING, path STRING, name STRING, tldr STRING, meta STRING, created_at DOUBLE, updated_at DOUBLE, protected INT, noise INT, canonical_name STRING, vectors_updated_at DOUBLE"
LINK = "linkage STRING, concept_id BIGINT, entity_id BIGINT, weight DOUBLE"
EVIDENCE = "entity_id BIGINT, linkage STRING, concept_id BIGINT, file STRING, line INT, span_end INT, detail STRING"
MEMORY = "entity_id BIGINT, content STRING, mtype STRING, tags STRING, metadata STRING, created_at DOUBLE, updated_at DOUBLE"


def canonical_verb(col: Column) -> Column:
    """A verb in its canonical spelling."""
    out = col
    for alias, verb in VERB_ALIASES.items():
        out = F.when(col == alias, F.lit(verb)).otherwise(out)
    return out


def stored_verb(col: Column) -> Column:
    """A verb as dirty stores spell it, in lower case and with ``-`` for ``_``."""
    return F.translate(F.lower(col), "_", "-")
