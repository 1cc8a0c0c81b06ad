"""Words, phrases, templates and patterns that results depend on, stated as they are."""

#: Substrings of addresses that a link filter drops.
BLACKLIST = ("google", "wikipedia", "youtube", "twitter", "facebook", "instagram", "linkedin", "pinterest", "reddit", "quora", "tiktok", "tumblr", "gov")

#: A statement that holds one of these reports nothing: when statements are read, when templated questions are made, when other questions are made.
NO_EVENT_READ = ("No events", "No significant updates", "No specific event", "Information on", "not provided", "No event from the provided article")
NO_EVENT_TEMPLATED = ("No events", "No specific event", "No known significant events")
NO_EVENT_GENERATED = ("No events", "No specific event")
FILLER = "No known significant events reported for this timeframe."

EVENT_TYPES = ("Fire", "Flood", "Hurricane", "Tornado", "Earthquake", "Volcano", "Drought", "Landslide", "Storm")
EVENT_KEYWORDS = {
    "Fire": ("fire", "burn", "flame", "wildfire", "forest fire", "brush fire"),
    "Flood": ("flood", "inundation", "water level", "high water", "overflow"),
    "Hurricane": ("hurricane", "cyclone", "typhoon", "storm surge"),
    "Tornado": ("tornado", "twister", "funnel cloud"),
    "Earthquake": ("earthquake", "quake", "tremor", "seismic"),
    "Volcano": ("volcano", "eruption", "lava", "ash cloud"),
    "Drought": ("drought", "dry", "water shortage"),
    "Landslide": ("landslide", "mudslide", "rockslide", "debris flow"),
    "Evacuation": ("evacuation", "evacuate", "evacuated", "evacuees"),
}
EVENT_PHRASES = ("fire", "wildfire", "forest fire", "hurricane", "storm", "flooding", "flood", "earthquake", "tsunami", "landslide", "evacuation", "tornado", "disaster", "emergency", "drought")
BEGINNING = ("began", "started", "initiated", "first", "beginning", "outbreak", "outbreak of")
DESCRIPTION = r"The ([A-Z][a-z]+ [A-Z]?[a-z]+ ?[A-Z]?[a-z]+)"

GENERIC_OPTIONS = ("None of the above", "Cannot be determined", "No event occurred")
NO_DATE_OPTION = "No event occurred on these dates"
TEMPLATES = {
    "temporal_grounding": (
        "Here are the dates for the images: {dates}. On which date did the {event_type} begin?",
        "Looking at these satellite images from {dates}, when did the {event_type} start?",
        "Based on this sequence of satellite images from {dates}, which date shows the first evidence of the {event_type}?",
    ),
    "event_type": (
        "What type of event is shown in these satellite images?",
        "What natural disaster is occurring in this location?",
        "Based on these satellite images, what event happened at this location?",
    ),
    "location_identification": ("Where is {location}? In pixel coordinates.",),
    "event_sequence": (
        "What is the correct sequence of events shown in these satellite images?",
        "Which option correctly describes the progression of the {event_type}?",
        "What sequence of events is shown in these images from {dates}?",
    ),
}
INTRODUCTION = "This is a sequence of sentinel-2 satellite images, centered at "
GENERATED_INTRODUCTION = "This is a sequence of satellite images:\n<video>\n"
DEFAULT_TYPE = "natural disaster"

CRITERIA = {
    "factual_accuracy": "FACTUAL ACCURACY",
    "completeness": "COMPLETENESS",
    "specificity": "SPECIFICITY",
    "visual_evidence": "VISUAL EVIDENCE UTILIZATION",
    "uncertainty_handling": "UNCERTAINTY HANDLING",
    "overall_score": "OVERALL SCORE",
}
