"""Fixed values of the domain: word lists, palettes, weights and limits that results depend on."""

# fixed values

CONTAMINATION_TYPES = (
    "sewage", "industrial_discharge", "algal_bloom", "solid_waste", "agricultural_runoff", "fish_kill", "foam", "oil_spill", "others",
)
MIME_TYPES = ("image/jpeg", "image/png", "image/jpg")
MAX_BYTES = 10 * 1024 * 1024
LEVELS = ("low", "moderate", "high")
LOW_MAX, MODERATE_MAX = 15.0, 35.0
WEIGHTS = {"algae": 0.15, "foam": 0.18, "turbidity": 0.18, "forel_ule": 0.10, "oil_sheen": 0.07, "color_abnormality": 0.15, "debris": 0.17}

# The 21 colours of the Forel-Ule water colour scale (red, green, blue), from 1 to 21.
FU_RGB = (
    (29, 98, 152), (34, 114, 148), (40, 130, 140), (47, 145, 130), (55, 158, 118), (65, 168, 105), (78, 175, 90),
    (95, 180, 75), (115, 183, 60), (138, 185, 48), (162, 185, 38), (185, 182, 30), (205, 175, 28), (222, 165, 28),
    (235, 152, 30), (244, 138, 32), (248, 120, 35), (250, 100, 38), (248, 78, 40), (242, 55, 42), (232, 32, 45),
)
FU_NAMES = (
    "Indigo Blue", "Dark Blue", "Blue", "Blue-Green", "Green-Blue", "Green", "Yellow-Green",
    "Greenish Yellow", "Yellow-Green", "Greenish Yellow", "Yellow-Brown", "Brownish Yellow", "Brownish", "Greenish Brown",
    "Brown", "Dark Brown", "Reddish Brown", "Brown-Red", "Dark Red-Brown", "Very Dark Brown", "Near Black",
)
FU_CATEGORIES = (("excellent", 3), ("good", 6), ("moderate", 10), ("poor", 14), ("very_poor", 18), ("critical", 21))

EXCLUDED_TERMS = (
    "chart", "diagram", "graph", "map", "plan", "silhouette", "icon", "logo", "sign", "svg", "infographic", "awareness",
    "treatment_plant", "wastewater_plant", "garbage_can", "family", "ducks", "hatchery", "satellite", "aerial_view",
    "residential_area", "pipeline", "infrastructure", "sightseeing_boat", "diesel_powered", "boat_plies", "oil_cleanup",
    "cleaninig_oil", "boats_on_oil", "harbour", "log_boom", "motel", "sunset", "fisherman", "fishermen", "construction_site", "docks",
)
FREE_LICENSES = ("cc0", "cc-by", "cc-by-sa", "pd", "public domain")
PHOTO_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff")

# Scene classes that hide the surface: saturated, shadow, clouds of two densities, cirrus, snow.
MASKED_SCL = (1, 3, 8, 9, 10, 11)
CLEAN_BASELINE_ONLINE, CLEAN_BASELINE_EXPORT = 0.015, 0.0155
BUFFERS = (150, 300, 500)
MIN_WATER_PIXELS, LOOKBACK_DAYS = 5, 180
MATCH_RADIUS = 500.0
EARTH_RADIUS = 6_371_008.8

DETECTORS = ("algae", "foam", "turbidity", "oil", "color_abnormality", "debris")
EXPECTED_DETECTORS = {
    "algal_foam": ("algae", "foam"), "garbage": ("debris",), "plastic": ("debris",), "oily_chemical": ("oil",),
    "sewage": ("color_abnormality", "turbidity"), "polluted_lakes": ("algae", "color_abnormality"),
    "polluted_rivers": ("turbidity", "color_abnormality"), "marine": ("color_abnormality",),
}
