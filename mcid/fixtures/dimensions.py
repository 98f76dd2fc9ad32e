"""Sample camera topology used by the derived views (fixed values)."""

# camera_id, name, stream key, width, height, fps target, active
CAMERAS = [
    ("CAM_01", "Entrance Main", "CAM_01_RTSP_URL", 1920, 1080, 25, True),
    ("CAM_02", "Showroom Floor North", "CAM_02_RTSP_URL", 1920, 1080, 25, True),
    ("CAM_03", "Showroom Floor South", "CAM_03_RTSP_URL", 1920, 1080, 25, True),
    ("CAM_04", "VIP Lounge", "CAM_04_RTSP_URL", 1280, 720, 15, True),
    ("CAM_05", "Workshop / Service Bay", "CAM_05_RTSP_URL", 1920, 1080, 15, True),
]

# from, to, min seconds, max seconds, probability, enabled
LINKS = [
    ("CAM_01", "CAM_02", 10, 90, 0.85, True),
    ("CAM_01", "CAM_03", 15, 120, 0.70, True),
    ("CAM_02", "CAM_03", 20, 180, 0.60, True),
    ("CAM_02", "CAM_04", 30, 300, 0.40, True),
    ("CAM_03", "CAM_05", 30, 180, 0.30, True),
    ("CAM_01", "CAM_04", 0, 0, 0.0, False),
    ("CAM_04", "CAM_01", 0, 0, 0.0, False),
]

# zone_id, camera_id, name, polygon, type, entry, exit, enabled, declaration order
ZONES = [
    ("Z01_CAM01_ENTRY", "CAM_01", "Entry Zone", "[[0.40,0.0],[0.60,0.0],[0.60,0.50],[0.40,0.50]]", "entry", True, False, True, 1),
    ("Z02_CAM01_EXIT", "CAM_01", "Exit Zone", "[[0.40,0.50],[0.60,0.50],[0.60,1.0],[0.40,1.0]]", "exit", False, True, True, 2),
    ("Z03_CAM02_FLOOR", "CAM_02", "Floor Zone", "[[0.10,0.10],[0.90,0.10],[0.90,0.90],[0.10,0.90]]", "floor", False, False, True, 3),
    ("Z04_CAM03_DISPLAY", "CAM_03", "Display & Test Zone", "[[0.20,0.30],[0.80,0.30],[0.80,0.80],[0.20,0.80]]", "display", False, False, True, 4),
    ("Z05_CAM04_VIP", "CAM_04", "VIP Zone", "[[0.15,0.15],[0.85,0.15],[0.85,0.85],[0.15,0.85]]", "vip", False, False, True, 5),
    ("Z06_CAM05_WORKSHOP", "CAM_05", "Workshop Zone", "[[0.10,0.10],[0.90,0.10],[0.90,0.90],[0.10,0.90]]", "workshop", False, False, True, 6),
]
