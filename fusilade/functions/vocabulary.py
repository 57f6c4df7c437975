"""Vocabularies and stop lists of the domain. Every operator takes its own as a parameter; these are the defaults."""

# Fixed values, in natural order.
PLANETS = ("sun", "moon", "mercury", "venus", "mars", "jupiter", "saturn", "uranus", "neptune", "pluto", "chiron", "lilith", "north node", "south node", "ascendant", "midheaven")
SIGNS = ("aries", "taurus", "gemini", "cancer", "leo", "virgo", "libra", "scorpio", "sagittarius", "capricorn", "aquarius", "pisces")
ASPECTS = ("conjunction", "conjunct", "opposition", "trine", "square", "sextile", "quincunx", "semisextile", "semisquare", "sesquiquadrate")
HEADING_BODIES = ("sun", "moon", "mercury", "venus", "mars", "jupiter", "saturn", "uranus", "neptune", "pluto", "ascendant", "midheaven")
HEADING_ASPECTS = ("conjunct", "sextile", "square", "trine", "opposition", "quincunx", "semisextile", "semisquare")
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth")
# Fixed values, in natural order: words that frame a question without content.
FRAME_WORDS = (
    "which what who whose whom when where why how make makes making made cause causes caused give gives given mean means meaning indicate "
    "indicates show shows represent represents describe tell explain you your yours my mine me i we our us a an the in of to do does did is "
    "are am be been being on for with that this these those and or but if as at by from about person people someone somebody one their "
    "them they he she his her him its it combination combinations placement placements position positions aspect aspects natal birth chart "
    "charts horoscope horoscopes astrology astrological zodiac sign signs"
).split()
# Fixed values, in natural order: words left out of a diagnosis of matched terms.
DIAGNOSTIC_STOP_WORDS = "what does do mean means is are the a an in of my your his her to and for how with when it that this i you natal chart".split()
# Fixed values, in natural order: aspects that a scan for heading lines knows.
SCANNED_ASPECTS = ("conjunct", "sextile", "square", "trine", "opposition", "conjunction", "quincunx", "semisextile")
