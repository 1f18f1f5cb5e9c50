"""How chapters' headings begin in the nine languages; a pattern of both SQL dialects, case ignored."""

HEADINGS = r"(?:chapter|chapitre|kapitel|capítulo|глава|अध्याय|บทที่)\s|第"
