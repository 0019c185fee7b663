"""Page plans over streams of files."""
