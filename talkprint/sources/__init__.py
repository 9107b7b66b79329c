"""talkprint.sources"""
