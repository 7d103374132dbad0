"""Files that come in and go out: sheets, lists, census tables, GeoJSON, backups."""
