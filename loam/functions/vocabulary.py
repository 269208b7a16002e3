"""The vocabularies by which texts are tagged. Matching is by substring of the lowered text."""

THEME_KEYWORDS = {
    "glof": ["glof", "glacial lake outburst", "moraine dam", "supraglacial"],
    "flood": ["flood", "inundation", "flash flood", "debris flow", "discharge"],
    "landslide": ["landslide", "slope failure", "mass movement", "rockfall"],
    "earthquake": ["earthquake", "seismic", "tectonic", "richter"],
    "glacier": ["glacier", "ice melt", "snow cover", "permafrost", "cryosphere"],
    "climate": ["climate change", "warming", "precipitation trend", "monsoon"],
    "forest": ["forest", "community forest", "afforestation", "deforestation"],
    "biodiversity": ["biodiversity", "wildlife", "species", "habitat", "conservation"],
    "forest_fire": ["forest fire", "wildfire", "burn", "fire risk"],
    "water": ["water quality", "hydrology", "river", "streamflow", "watershed"],
    "hydropower": ["hydropower", "hydroelectric", "dam", "reservoir", "turbine"],
    "agriculture": ["agriculture", "crop", "farming", "yield", "irrigation"],
    "livelihood": ["livelihood", "income", "poverty", "adaptation", "vulnerability"],
    "air": ["air quality", "pm2.5", "pm10", "pollution", "emission"],
    "urban_heat": ["urban heat", "heat island", "temperature rise", "land surface"],
    "land_use": ["land use", "land cover", "remote sensing", "gis", "satellite"],
    "policy": ["policy", "governance", "regulation", "eia", "institution"],
    "geology": ["geology", "stratigraphy", "rock", "mineral", "fault"],
    "health": ["health", "microbiology", "food safety", "nutrition", "disease"],
    "disaster": ["disaster", "hazard", "risk", "vulnerability", "early warning"],
}

RIVER_BASINS = [
    "koshi", "saptakoshi", "gandaki", "narayani", "karnali", "mahakali",
    "bagmati", "rapti", "kamala", "trishuli", "sun koshi", "tamakoshi",
    "bhotekoshi", "dudhkoshi", "marsyangdi", "bheri", "seti", "modi",
    "madi", "tinau", "west rapti", "east rapti",
]

DISTRICTS = [
    "kathmandu", "lalitpur", "bhaktapur", "chitwan", "makwanpur",
    "sindhupalchok", "dolakha", "solukhumbu", "taplejung", "sankhuwasabha",
    "rasuwa", "dhading", "nuwakot", "gorkha", "manang", "mustang",
    "kaski", "lamjung", "syangja", "parbat", "myagdi", "baglung",
    "dolpa", "mugu", "humla", "jumla", "kalikot", "jajarkot",
    "bajhang", "bajura", "darchula", "baitadi", "dadeldhura",
    "kanchanpur", "kailali", "bardiya", "banke", "dang", "salyan",
    "rukum", "rolpa", "pyuthan", "gulmi", "arghakhanchi", "palpa",
    "kapilvastu", "rupandehi", "nawalparasi", "parsa", "bara",
    "rautahat", "sarlahi", "mahottari", "dhanusha", "siraha",
    "saptari", "udayapur", "okhaldhunga", "khotang", "bhojpur",
    "dhankuta", "terhathum", "panchthar", "ilam", "jhapa",
    "morang", "sunsari",
]
