"""Fixed values.

Everything in this file is a value that results depend on: word lists, label
tables, sentence templates and default thresholds.  None of it is logic.
"""

# --- thresholds -------------------------------------------------------------
SUPPRESSION_THRESHOLD = 5
WINDOW_DAYS = 365
TOP_VALUES = 5
FUZZY_THRESHOLD = 0.84
MIN_MATCH_RATE = 0.95
GENERIC_TOKEN_MAX_DF = 0.05
BOX_PAD_DEGREES = 1.5
SWING_MIN_ABS = 25.0
SWING_MIN_SHARE = 0.10
WITHIN_TOLERANCE = 0.5
TOP_RESULTS = 300
DISTRIBUTION_LIMIT = 8
EARTH_RADIUS_MILES = 3958.8
SESSION_GAP_MINUTES = 30
MIN_PING_MS = 1000
ENGAGED_PING_MS = 10000
MIN_REGISTRY_ROWS = 700
MIN_EVENT_ROWS = 500_000
MIN_LISTING_ROWS = 100
MAX_SUMMARY_CHARS = 360

# Inclusive bounds and label of each age band.
AGE_BANDS = (
    (0, 17, "0-17"),
    (18, 24, "18-24"),
    (25, 34, "25-34"),
    (35, 44, "35-44"),
    (45, 54, "45-54"),
    (55, 64, "55-64"),
    (65, 200, "65+"),
)

# --- name normalisation -----------------------------------------------------
ABBREVIATIONS = {
    "CTR": "CENTER",
    "CO": "COUNTY",
    "DET": "DETENTION",
    "FAC": "FACILITY",
    "CORR": "CORRECTIONAL",
    "INST": "INSTITUTION",
    "FED": "FEDERAL",
    "PROC": "PROCESSING",
}
STOPWORDS = ("THE", "OF", "AND", "DEPT")
TITLE_ACRONYMS = ("ICE", "US")

# --- place names ------------------------------------------------------------
# Census designators at the end of a place name.
PLACE_DESIGNATORS = (
    "city and borough", "consolidated government", "metropolitan government",
    "unified government", "urban county", "municipality", "corporation",
    "borough", "village", "township", "town", "city", "cdp", "comunidad",
    "zona urbana", "plantation", "gore", "grant", "location", "reservation",
)
PLACE_PREFIXES = ("town of ", "city of ", "village of ", "borough of ")
# Words that say what an entity is, not where it is.
ROLE_WORDS = (
    "detention and removal operations", "command center", "district office",
    "field office", "sub office", "suboffice", "processing center", "service center",
    "holding facility", "detention center", "detention facility", "staging facility",
    "hold room", "holding room", "hold rooms", "holdroom", "staging area",
    "county jail", "medical center", "hospital", "airport", "annex",
    "hold", "holding", "jail", "prison", "facility", "office", "staging",
    "ero", "ice", "ins", "usms", "dro", "fo", "spc", "cdf",
)
PLACE_SOURCE = "US Census Bureau 2024 Gazetteer (place interior point)"
COUNTY_SOURCE = "US Census Bureau 2024 Gazetteer (county interior point)"
STATE_SOURCE = "Mean of county interior points, US Census Bureau 2024 Gazetteer"
DERIVED_LOCATION_NOTE = "Derived location — not a published facility address."
UNPLACED_NOTE = (
    "No location is published for this facility beyond its state, and it could not be placed."
)
# Sentence for each derived precision; {place} is the matched place.
PRECISION_NOTES = {
    "city_centroid": "No address is published for this facility, so it is placed at the "
    "centre of {place} — somewhere in this city, not at this point.",
    "manual_city_centroid": "Placed by hand at the centre of {place}; no address is "
    "published. Somewhere in this city, not at this point.",
    "county_centroid": "No address or city is published, so it is placed at the centre "
    "of {place} — somewhere in this county.",
    "manual_county_seat": "Placed by hand near {place}; no address is published for "
    "this facility.",
    "manual_office_code": "The facility is identified only by an ICE office code, read "
    "here as {place}. Inferred from the code, not from a published address.",
    "manual_facility_area": "Placed by hand in the area of {place}; no street address "
    "is published.",
    "state_centroid": "Nothing beyond the state is published for this facility, so it "
    "sits at the centre of {place} as a placeholder. Do not read the position as a "
    "location at all.",
}

# --- record assembly --------------------------------------------------------
COMPANY_STATUS = "not_yet_researched"
STALE_NOTE = (
    "This facility appears to have come into use after the trailing-year window closed. "
    "Over that window it held at most {peak}, so the trailing-year average below "
    "understates it badly. ICE's fiscal-year figures are the current ones for this facility."
)
ABSENT_GUARD_COUNT = (
    "ICE does not publish facility staffing levels, and they do not appear in FOIA "
    "releases. Closest published proxy: guaranteed minimum beds."
)
MEASURE = "flow"
MEASURE_NOTE = (
    "Counts people booked in during the window, not people held on any given day. Not "
    "comparable to average daily population."
)

# --- display ----------------------------------------------------------------
NOT_REPORTED = "Not publicly reported"
NOT_PUBLISHED = "not published"
UNNAMED = "Unnamed facility"
CONTRACT_LABELS = {
    "IGSA": "Intergovernmental Service Agreement (local government)",
    "DIGSA": "Dedicated Intergovernmental Service Agreement",
    "CDF": "Contract Detention Facility (private operator)",
    "USMS IGA": "US Marshals intergovernmental agreement",
    "USMS CDF": "US Marshals contract detention facility",
    "BOP": "Federal Bureau of Prisons",
    "SPC": "Service Processing Center (ICE-owned)",
    "STAGING": "Staging facility",
    "STATE": "State facility",
    "FAMILY": "Family residential centre",
}
RATING_FAIL_PATTERN = "fail"
RATING_PASS_PATTERN = "pass|meets|acceptable|superior|good"

# --- release diff -----------------------------------------------------------
# Column of the flat release table -> label used in the change text.
ATTRIBUTE_LABELS = {
    "last_rating": "inspection rating",
    "last_end_date": "inspection date",
    "contract_type": "contract type",
    "company": "operator",
}

# --- campaign contract ------------------------------------------------------
CAMPAIGN_FIELDS = (
    "case_id", "region", "bond_amount", "amount_raised", "booking_category",
    "verified_on", "verification_expires_on", "public_summary", "contribution_url",
    "contribution_recipient", "terms_url", "status", "consent_confirmed",
)
CAMPAIGN_STATUSES = ("accepting", "funded", "bond_posted", "released", "paused")
CAMPAIGN_ID_PATTERN = "^BF-[A-Z0-9]{6,16}$"
IDENTIFIER_PATTERN = r"\bA[- ]?\d{8,9}\b"
# code -> (label, note)
BOOKING_CATEGORIES = {
    "conviction_reported": (
        "Conviction reported",
        "A conviction was reported in the case record reviewed by the partner.",
    ),
    "pending_charge_reported": (
        "Pending charge reported",
        "A pending charge was reported; a charge is not a conviction.",
    ),
    "immigration_only": (
        "Immigration-only classification",
        "No criminal charge or conviction was reported in the reviewed booking record.",
    ),
    "not_reported": (
        "Not reported",
        "The partner did not publish a criminal-history classification for this case.",
    ),
}
