"""Code tables and labels of the listing domain, and the lookups over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Request codes.
OFFERING_BY_CATEGORY = {1: "1", 2: "2", 3: "3", 4: "3", 5: "1"}
TYPE_BY_ID = {
    1: "apartment", 35: "villa", 22: "townhouse", 20: "penthouse", 24: "duplex", 5: "land", 4: "office",
}
FURNISHED_BY_CODE = {1: ["1", "yes", "true"], 2: ["0", "no", "false"], 3: ["partly"]}
COMPLETION_BY_CODE = {0: ["completed", "ready"], 1: ["off_plan", "offplan"], 2: ["off_plan", "offplan"]}
OFFERING_BY_WORD = {"sale": "1", "buy": "1", "rent": "2", "lease": "2"}
SORTS = ["featured", "newest", "priceAsc", "priceDesc", "bedroomAsc", "bedroomDesc"]

# Event names.
VIEW_EVENTS = ["content_view"]
CLICK_EVENTS = ["lead_click", "new_projects_lead_click"]
LEAD_EVENTS = ["lead_send", "new_projects_lead_send", "instapage_lead"]

# Text shown when a listing lacks it.  The image is this
# project's own placeholder; pass another to the jobs that use it.
DEFAULT_IMAGE = "https://example.com/listing/default.jpg"
DEFAULT_AGENT = "Property Consultant"
DEFAULT_TITLE = "Listing"
CURRENCY = "AED"


def lookup(table: dict, key: Column) -> Column:
    """``table[key]``; null where the key is unknown or null."""
    found = None
    for known, value in table.items():
        entry = F.array(*[F.lit(item) for item in value]) if isinstance(value, list) else F.lit(value)
        found = F.when(key == known, entry) if found is None else found.when(key == known, entry)
    return found


def offering_word(word: Column) -> Column:
    """Offering words become codes; anything else stays as it is."""
    return F.coalesce(lookup(OFFERING_BY_WORD, word), word)


def type_names(ids: Column) -> Column:
    """The property-type names of an id list, unknown ids left out; null when none remain."""
    names = F.filter(F.transform(ids, lambda i: lookup(TYPE_BY_ID, i)), lambda n: n.isNotNull())
    return F.when(F.size(names) > 0, names)
