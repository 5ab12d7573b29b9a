"""Spark jobs that resolve event listings against music playlists."""
