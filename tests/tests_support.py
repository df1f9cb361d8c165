import os

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
