"""talkprint.operators"""
