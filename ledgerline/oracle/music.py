from ledgerline.oracle.kit import pct, using

_CLEAN = """
c AS (SELECT user_id, track, artist, CASE WHEN genre IN ('hip', 'hop', 'hip-hop') THEN 'hiphop' ELSE genre END AS genre,
             city, time, day
      FROM (SELECT DISTINCT "userID" AS user_id, COALESCE("Track", 'unknown') AS track,
                   COALESCE(artist, 'unknown') AS artist, COALESCE(genre, 'unknown') AS genre, "City" AS city, time,
                   "Day" AS day FROM plays))"""
_W = using("plays", rest=_CLEAN)
_COLS = {"userid": '"userID"', "track": '"Track"', "artist": "artist", "genre": "genre", "city": '"City"',
         "time": "time", "day": '"Day"'}

SQL = {
    "mus_clean": _W + "SELECT * FROM c",
    "mus_nulls": using("plays") + " UNION ALL ".join(
        f"SELECT '{n}' AS \"column\", COUNT(*) - COUNT({c}) AS null_cnt, {pct(f'COUNT(*) - COUNT({c})', 'COUNT(*)')} "
        f"AS null_percent FROM plays" for n, c in _COLS.items()),
    "mus_genres": _W + "SELECT DISTINCT genre FROM c",
    "mus_plays_by_city": _W + "SELECT city, COUNT(track) AS plays FROM c GROUP BY 1",
    "mus_plays_by_day": _W + "SELECT day, COUNT(track) AS plays FROM c GROUP BY 1",
    "mus_city_day": _W + """SELECT city, COUNT(CASE WHEN day = 'Monday' THEN 1 END) AS monday,
        COUNT(CASE WHEN day = 'Wednesday' THEN 1 END) AS wednesday, COUNT(CASE WHEN day = 'Friday' THEN 1 END) AS friday
        FROM c GROUP BY 1""",
    "mus_genre_weekday_top10": _W + """SELECT genre, COUNT(*) AS plays FROM c
        WHERE day = 'Monday' AND time > '07:00' AND time < '11:00' GROUP BY 1 ORDER BY plays DESC, genre LIMIT 10""",
    "mus_genre_slots": _W + """SELECT * FROM (
        SELECT city, slot, genre, COUNT(*) AS plays,
               ROW_NUMBER() OVER (PARTITION BY city, slot ORDER BY COUNT(*) DESC, genre) AS place
        FROM (SELECT *, CASE WHEN day = 'Monday' AND time > '07:00' AND time < '11:00' THEN 'Monday 07:00-11:00'
                             WHEN day = 'Friday' AND time > '17:00' AND time < '23:00' THEN 'Friday 17:00-23:00' END AS slot
              FROM c) WHERE slot IS NOT NULL GROUP BY 1, 2, 3) WHERE place <= 10""",
    "mus_genre_by_city": _W + """SELECT genre, COUNT(*) AS plays FROM c WHERE city = 'Moscow' GROUP BY 1
        ORDER BY plays DESC, genre LIMIT 10""",
}
