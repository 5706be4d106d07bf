"""Domain constants of the comment analyses.

FIXED VALUES: these must equal the values the original analyses use, so that
results agree. They are kept here in their natural order and passed to the
operators as defaults; every operator accepts its own list instead.
"""

# FIXED VALUES -- stances, in the order the stance plots use.
STANCES = ["Supports", "Objects", "Neutral"]

# FIXED VALUES -- housing types, in display order.
HOUSING_ORDER = [
    "Market housing",
    "Mixed affordable housing",
    "Mixed social housing",
    "Social housing",
    "Self-build housing",
    "Other",
]

# FIXED VALUES -- the 14 inner London boroughs.
INNER_LONDON_BOROUGHS = [
    "Camden", "Greenwich", "Hackney", "Hammersmith and Fulham",
    "Islington", "Kensington and Chelsea", "Lambeth", "Lewisham",
    "Southwark", "Tower Hamlets", "Wandsworth", "Westminster",
    "City of London", "Newham",
]

# FIXED VALUES -- topic ids counted as "NIMBY" topics.
NIMBY_TOPIC_IDS = [1, 2, 3, 5, 8, 9, 11, 12, 17, 28, 33, 55, 58]

# FIXED VALUES -- census columns summed into the three socio-demographic shares.
CENSUS_AGE_50_PLUS = [
    "Aged 50 to 54", "Aged 55 to 59", "Aged 60 to 64",
    "Aged 65 to 69", "Aged 70 to 74", "Aged 75 to 79",
    "Aged 80 to 84", "Aged 85 and over",
]
CENSUS_AGE_TOTAL = "All usual residents"
CENSUS_OCCUPATION_1_2_3 = [
    "1. Managers, directors and senior officials",
    "2. Professional occupations",
    "3. Associate professional and technical occupations",
]
CENSUS_OCCUPATION_TOTAL = "All usual residents aged 16 and over in employment"
CENSUS_OWNED = ["Owned outright", "Owned with a mortgage or loan"]
CENSUS_HOUSEHOLDS_TOTAL = "All Households"

SOCIO_VARS = ["percent_age_50_plus", "percent_occupation_1_2_3", "percent_owned_total"]

# FIXED VALUES -- fallback labels and colours.
OTHER_LABEL = "other"
OTHER_COLOR_PIE = "#888888"
OTHER_COLOR_NIMBY = "#000000"
OTHER_TOPIC_NIMBY = -999
UNCLASSIFIED_LABEL = "unclassified"
UNCLASSIFIED_COLOR = "#666666"
HIGHLIGHT_FALLBACK_COLOR = "#DDEA2C"

# FIXED VALUES -- plot parameters that define the tables behind the figures.
TOP_TOPICS_BAR = 20          # bars in the topic charts and pies
TOP_TOPICS_COOCCURRENCE = 15
TOP_TOPICS_DISTANCE = 15
BOROUGH_LEGEND_TOP = 10
EARTH_RADIUS_KM = 6371.0
MAP_PAD_DEG = 0.04
EXTENT_MARGIN_FRACTION = 0.05
# FIXED VALUES -- planning authorities that are no boroughs but have labels on the map.
EXTRA_LPAS = ["LLDC", "OPDC"]
